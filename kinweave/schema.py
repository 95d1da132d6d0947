"""Record layout, trust tables and fixed dictionaries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F, types as T

# ---------------------------------------------------------------- types ----

LOCATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("city", "region", "country", "raw")]
)
LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "type")])
EXPERIENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("company", "title", "start_date", "end_date", "location")]
)
EDUCATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("institution", "degree", "field", "graduation_date")]
)
# Total order over records: (origin, block, pos). Origin is the file or table a
# record came from; only comparisons are used, never the numbers themselves.
RECORD_SEQ = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("item", T.LongType()),
    ]
)
GITHUB_META = T.StructType(
    [
        T.StructField("handle", T.StringType()),
        T.StructField("public_repos", T.LongType()),
        T.StructField("followers", T.LongType()),
        T.StructField("following", T.LongType()),
        T.StructField("avatar_url", T.StringType()),
        T.StructField("html_url", T.StringType()),
    ]
)
LINKEDIN_META = T.StructType(
    [
        T.StructField("handle", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("enriched", T.BooleanType()),
    ]
)

CONFIDENCE = T.DecimalType(4, 3)
# Sums of weight x confidence: six decimals are exact for three-digit factors.
WEIGHT_SUM = T.DecimalType(38, 6)

RECORD = T.StructType(
    [
        T.StructField("record_seq", RECORD_SEQ),
        T.StructField("source", T.StringType()),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("confidence", CONFIDENCE),
        T.StructField("full_name", T.StringType()),
        T.StructField("emails", T.ArrayType(T.StringType())),
        T.StructField("phones", T.ArrayType(T.StringType())),
        T.StructField("location", LOCATION),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("headline", T.StringType()),
        T.StructField("years_experience", T.DoubleType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("experience", T.ArrayType(EXPERIENCE)),
        T.StructField("education", T.ArrayType(EDUCATION)),
        T.StructField("error", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("github_meta", GITHUB_META),
        T.StructField("linkedin_meta", LINKEDIN_META),
    ]
)

SCALAR_FIELDS = ("full_name", "headline", "location", "years_experience", "candidate_id")
LIST_FIELDS = ("emails", "phones", "links", "skills", "experience", "education")

CANONICAL_TYPES = {
    "candidate_id": T.StringType(),
    "full_name": T.StringType(),
    "emails": T.ArrayType(T.StringType()),
    "phones": T.ArrayType(T.StringType()),
    "location": LOCATION,
    "links": T.ArrayType(LINK),
    "headline": T.StringType(),
    "years_experience": T.DoubleType(),
    "skills": T.ArrayType(T.StringType()),
    "experience": T.ArrayType(EXPERIENCE),
    "education": T.ArrayType(EDUCATION),
}

# --------------------------------------------------------- fixed values ----
# Trust per source: weight, default confidence.
SOURCE_TRUST = {
    "ats_json": (Decimal("1.0"), Decimal("0.95")),
    "linkedin": (Decimal("0.9"), Decimal("0.85")),
    "recruiter_csv": (Decimal("0.85"), Decimal("0.9")),
    "github": (Decimal("0.8"), Decimal("0.75")),
    "resume": (Decimal("0.7"), Decimal("0.8")),
    "recruiter_notes": (Decimal("0.4"), Decimal("0.55")),
}
OTHER_WEIGHT = Decimal("0.3")
OTHER_CONFIDENCE = Decimal("0.5")
FREE_TEXT_CONFIDENCE = Decimal("0.7")
FAILED_CONFIDENCE = Decimal("0.0")
REFERENCE_ONLY_CONFIDENCE = Decimal("0.35")

# Skill spellings (fixed values).
SKILL_ALIASES = {
    "js": "JavaScript", "javascript": "JavaScript", "java script": "JavaScript",
    "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "ts": "TypeScript", "typescript": "TypeScript",
    "py": "Python", "python": "Python", "python3": "Python",
    "react": "React", "reactjs": "React", "react.js": "React",
    "next.js": "Next.js", "nextjs": "Next.js", "next": "Next.js",
    "golang": "Go", "go": "Go",
    "k8s": "Kubernetes", "kubernetes": "Kubernetes",
    "aws": "AWS", "amazon web services": "AWS",
    "gcp": "GCP", "google cloud": "GCP", "google cloud platform": "GCP",
    "ml": "Machine Learning", "machine learning": "Machine Learning",
    "dl": "Deep Learning", "deep learning": "Deep Learning",
    "nlp": "NLP", "natural language processing": "NLP",
    "sql": "SQL", "mysql": "MySQL", "postgres": "PostgreSQL", "postgresql": "PostgreSQL",
    "mongo": "MongoDB", "mongodb": "MongoDB",
    "docker": "Docker", "git": "Git", "github": "GitHub", "linux": "Linux",
    "rest": "REST APIs", "rest api": "REST APIs", "rest apis": "REST APIs",
    "graphql": "GraphQL", "html": "HTML", "css": "CSS",
    "redis": "Redis", "kafka": "Kafka",
    "java": "Java", "c++": "C++", "cpp": "C++", "c#": "C#", "csharp": "C#",
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "express": "Express.js",
    "tensorflow": "TensorFlow", "pytorch": "PyTorch", "sklearn": "scikit-learn",
    "scikit-learn": "scikit-learn",
}

# Country names (fixed values). Two-letter spellings never reach this table.
COUNTRY_CODES = {
    "united states": "US", "usa": "US", "u.s.a.": "US", "u.s.": "US", "america": "US",
    "india": "IN", "bharat": "IN",
    "united kingdom": "GB", "britain": "GB", "england": "GB",
    "canada": "CA",
    "germany": "DE", "deutschland": "DE",
    "france": "FR",
    "australia": "AU",
    "singapore": "SG",
    "brazil": "BR",
    "japan": "JP",
    "china": "CN",
}

# Month words (fixed values).
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# Terms looked for in note blocks (fixed values).
NOTE_TERMS = (
    "JavaScript", "TypeScript", "Python", "Go", "Java", "React", "Node.js", "Next.js",
    "AWS", "GCP", "Kubernetes", "Docker", "PostgreSQL", "MongoDB", "Redis", "Kafka",
    "Machine Learning", "Deep Learning", "NLP", "SQL", "GraphQL", "TensorFlow", "PyTorch",
    "Django", "Flask", "FastAPI", "Express.js", "REST APIs",
)

# Terms looked for in free-text documents without a skills section (fixed values).
DOCUMENT_TERMS = (
    "JavaScript", "TypeScript", "Python", "Go", "Java", "C++", "C#", "Swift",
    "React", "Node.js", "Next.js", "Express.js", "Django", "Flask", "FastAPI",
    "AWS", "GCP", "Azure", "Kubernetes", "Docker", "Terraform",
    "PostgreSQL", "MySQL", "MongoDB", "Redis", "Kafka",
    "Machine Learning", "Deep Learning", "NLP", "TensorFlow", "PyTorch", "scikit-learn",
    "SQL", "GraphQL", "REST APIs", "HTML", "CSS", "Git", "Linux",
)

# Section headings of free-text documents (fixed values).
SECTION_HEADINGS = {
    "summary": ("summary", "about", "profile", "objective"),
    "skills": ("skills", "technical skills", "core skills"),
    "experience": ("experience", "work experience", "professional experience", "employment"),
    "education": ("education",),
}

# First path parts that are never an account name (fixed values).
GITHUB_RESERVED = (
    "settings", "login", "orgs", "topics", "trending",
    "marketplace", "about", "pricing", "features", "enterprise",
)

# Column spellings of delimited files, per target field (fixed values).
COLUMN_ALIASES = {
    "candidate_id": ("candidate_id", "id", "candidateid"),
    "name": ("name", "full_name", "fullname", "candidate"),
    "email": ("email", "emails", "work_email", "e-mail"),
    "phone": ("phone", "phones", "mobile", "contact", "phone_number"),
    "location": ("location", "city", "address"),
    "headline": ("headline", "title", "role", "current_role", "position"),
    "company": ("company", "current_company", "employer"),
    "years": ("years_experience", "years", "yoe", "experience_years", "experience"),
    "skills": ("skills", "technical_skills"),
    "linkedin": ("linkedin", "linkedin_url"),
    "github": ("github", "github_url"),
    "portfolio": ("portfolio", "website", "personal_site"),
}

# Numbering plans: country -> (calling code, trunk prefix, pattern of the
# national number). Public numbering facts, kept to lengths and leading digits.
NUMBERING_PLANS = {
    "US": ("1", "1", "[2-9][0-9]{9}"),
    "CA": ("1", "1", "[2-9][0-9]{9}"),
    "MX": ("52", "", "[1-9][0-9]{9}"),
    "GB": ("44", "0", "[1-9][0-9]{8,9}"),
    "IN": ("91", "0", "[1-9][0-9]{9}"),
    "DE": ("49", "0", "[1-9][0-9]{5,10}"),
    "FR": ("33", "0", "[1-9][0-9]{8}"),
    "AU": ("61", "0", "[1-578][0-9]{8}"),
    "SG": ("65", "", "[3689][0-9]{7}"),
    "BR": ("55", "0", "[1-9][0-9]{9,10}"),
    "JP": ("81", "0", "[1-9][0-9]{8,9}"),
    "CN": ("86", "0", "[1-9][0-9]{9,10}"),
    "KR": ("82", "0", "[1-9][0-9]{7,9}"),
    "IR": ("98", "0", "[1-9][0-9]{9}"),
}


def conform(df: DataFrame) -> DataFrame:
    """Project onto the record layout, adding typed nulls for absent columns.

    Positions without an item index, of rows that hold one record, get item 0.
    """
    have = set(df.columns)
    if "record_seq" in have and "item" not in df.schema["record_seq"].dataType.names:
        df = df.withColumn("record_seq", F.struct(*[f"record_seq.{n}" for n in ("origin", "block", "pos")], F.lit(0).alias("item")))
    return df.selectExpr(
        *[f"CAST({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in RECORD.fields]
    )
