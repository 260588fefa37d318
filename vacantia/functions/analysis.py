"""Deterministic analysis of a description: technologies, seniority, education, years of experience, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as t

# Canonical names and the phrases that stand for them.
TECHNOLOGIES = {
    "Java": ["java"], "Spring": ["spring", "spring framework"], "Spring Boot": ["spring boot"], "React": ["react", "react.js", "reactjs"], "TypeScript": ["typescript"],
    "JavaScript": ["javascript", "java script"], "Node.js": ["node.js", "nodejs", "node js"], "Python": ["python"], "C": ["c language"], "C++": ["c++", "cpp"], "C#": ["c#", "c sharp"],
    ".NET": [".net", "dotnet"], "Go": ["golang", "go language"], "Rust": ["rust"], "Linux": ["linux"], "Docker": ["docker"], "Kubernetes": ["kubernetes", "k8s"],
    "REST": ["rest api", "restful", "rest"], "SQL": ["sql"], "PostgreSQL": ["postgresql", "postgres"], "MySQL": ["mysql"], "MongoDB": ["mongodb", "mongo db"], "Redis": ["redis"],
    "Git": ["git"], "Azure DevOps": ["azure devops"], "AWS": ["aws", "amazon web services"], "Azure": ["microsoft azure", "azure"], "GCP": ["gcp", "google cloud platform"],
    "Networking": ["networking", "computer networks"], "TCP/IP": ["tcp/ip", "tcp ip", "tcp", "ip networking"], "Embedded": ["embedded", "firmware"], "JavaFX": ["javafx"],
    "Maven": ["maven"], "Gradle": ["gradle"], "CI/CD": ["ci/cd", "continuous integration", "continuous delivery"], "Microservices": ["microservices", "micro services"],
    "HTML": ["html", "html5"], "CSS": ["css", "css3"], "Angular": ["angular", "angularjs"], "Vue": ["vue", "vue.js", "vuejs"], "Selenium": ["selenium"], "Playwright": ["playwright"],
    "Cypress": ["cypress"], "Jenkins": ["jenkins"], "GitHub Actions": ["github actions"], "Kafka": ["kafka", "apache kafka"], "RabbitMQ": ["rabbitmq", "rabbit mq"], "GraphQL": ["graphql"],
}
SENIORITY = {
    "student": ["student", "student position", "student role", "currently pursuing", "currently enrolled"],
    "intern": ["intern", "internship", "intern position", "software intern"],
    "junior": ["junior", "entry level", "entry-level", "new graduate", "recent graduate", "graduate position", "graduate developer", "graduate engineer"],
    "senior": ["senior", "staff engineer", "principal engineer", "technical lead", "tech lead", "team lead", "architect", "engineering manager"],
}
EDUCATION = {
    "degree-required": ["bachelor's degree required", "bachelors degree required", "b.sc. required", "bsc required", "degree in computer science required"],
    "degree-preferred": ["bachelor's degree preferred", "bachelors degree preferred", "degree preferred", "b.sc. preferred", "bsc preferred"],
    "degree-mentioned": ["bachelor's degree", "bachelors degree", "bachelor degree", "b.sc.", "bsc", "computer science degree", "degree in computer science", "software engineering degree"],
    "active-student": ["currently pursuing", "currently enrolled", "active student", "student with", "remaining semesters"],
}
EXPERIENCE_CONTEXT = ["experience", "professional", "hands-on", "hands on", "proven", "required", "requirement", "minimum", "at least", "must have", "working with", "development", "engineering", "software", "backend", "frontend", "full stack", "programming", "years in", "years with"]
# How years are written.
NONE_NEEDED = r"\bno\s+(?:prior\s+)?experience\s+(?:is\s+)?required\b|\bwithout\s+(?:prior\s+)?experience\b|\bexperience\s+is\s+not\s+required\b"
RANGE = r"\b(\d{1,2})\s*(?:-|to)\s*(\d{1,2})\s*(?:years?|yrs?)\b"
OPEN_ENDED = (
    r"\b(\d{1,2})\s*\+\s*(?:years?|yrs?)\b",
    r"\b(?:at\s+least|minimum(?:\s+of)?|min\.?)\s*(\d{1,2})\s*(?:years?|yrs?)\b",
    r"\b(\d{1,2})\s*(?:years?|yrs?)\s+(?:of\s+)?(?:relevant\s+|professional\s+|hands-on\s+|hands\s+on\s+)?experience\b",
    r"\b(\d{1,2})\s*(?:years?|yrs?)\s+(?:working\s+)?(?:in|with|developing|building)\b",
)
MOST_YEARS = 20


def technologies(text: Column) -> Column:
    """Canonical names; Spring is dropped where it only stands in Spring Boot."""
    names = []
    for name, aliases in TECHNOLOGIES.items():
        there = t.phrase(text, *aliases)
        if name == "Spring":
            there = there & (~t.phrase(text, *TECHNOLOGIES["Spring Boot"]) | t.phrase(F.regexp_replace(text, "spring boot", ""), "spring"))
        names.append(F.when(there, F.lit(name)))
    return F.array_compact(F.array(*names))


def fragments(text: Column) -> Column:
    """A normalised text (one line by then) cut after sentence ends and before bullets."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+|\s+[•●▪]\s+"), lambda x: F.trim(x)), lambda x: x != "")


def _years(low: Column, high: Column | None) -> Column:
    low = low.cast("int")
    high = F.lit(None).cast("int") if high is None else high.cast("int")
    return F.struct(F.when(high.isNotNull() & (low > high), high).otherwise(low).alias("low"), F.when(high.isNotNull() & (low > high), low).otherwise(high).alias("high"))


def experience_candidates(text: Column) -> Column:
    """Distinct (low, high) of the years asked for in fragments that speak of experience; high is null if open."""
    # Every form has one of these words: fragments without them needn't be looked at.
    dated = F.when(text.contains("year") | text.contains("yr"), F.filter(fragments(text), lambda f: f.contains("year") | f.contains("yr"))).otherwise(F.array().cast("array<string>"))
    context = F.filter(dated, lambda f: t.phrase(f, *EXPERIENCE_CONTEXT))
    # A fragment that holds several ranges is matched by each; pairs are read from the two groups side by side.
    ranges = F.flatten(F.transform(context, lambda f: F.zip_with(F.regexp_extract_all(f, F.lit(RANGE), F.lit(1)), F.regexp_extract_all(f, F.lit(RANGE), F.lit(2)), lambda a, b: _years(a, b))))
    opened = F.flatten(F.transform(context, lambda f: F.flatten(F.array(*[F.transform(F.regexp_extract_all(f, F.lit(p), F.lit(1)), lambda a: _years(a, None)) for p in OPEN_ENDED]))))
    nothing = F.when(text.rlike(NONE_NEEDED), F.array(_years(F.lit(0), F.lit(0)))).otherwise(F.array().cast("array<struct<low:int,high:int>>"))
    every = F.concat(nothing, ranges, opened)
    return F.array_distinct(F.filter(every, lambda c: F.coalesce(c["high"], c["low"]) <= MOST_YEARS))


def experience(text: Column) -> Column:
    """The strongest candidate: the highest low, then the highest high, an open one counting as 99."""
    best = F.array_max(F.transform(experience_candidates(text), lambda c: F.struct(c["low"].alias("low"), F.coalesce(c["high"], F.lit(99)).alias("high"))))
    return F.struct(best["low"].alias("low"), F.nullif(best["high"], F.lit(99)).alias("high"))


def experience_label(low: Column, seniority: Column) -> Column:
    """A broad level from the signals, else from the years."""
    out = F.when(F.array_contains(seniority, "student"), "student")
    for name in ("intern", "senior", "junior"):
        out = out.when(F.array_contains(seniority, name), name)
    return out.when(low.isNull(), "not-specified").when(low <= 1, "entry-level").when(low <= 3, "junior-to-mid").when(low <= 5, "mid-level").otherwise("senior")


def confidence(length: Column, technologies: Column, low: Column, seniority: Column, education: Column) -> Column:
    """Hundredths are summed as integers."""
    part = lambda cond, n: F.when(cond, n).otherwise(0)
    score = 35 + part(length >= 500, 15) + part(length >= 1500, 10) + part(F.size(technologies) > 0, 15) + part(low.isNotNull(), 15) + part(F.size(seniority) > 0, 5) + part(F.size(education) > 0, 5)
    return F.least(score, F.lit(100)) / 100


def analysed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the analysis of a text column."""
    text = "__text"
    df = df.withColumn(text, t.analysis_text(F.col(column)))
    df = df.withColumns({"technologies": technologies(F.col(text)), "seniority_signals": t.alias_groups(F.col(text), SENIORITY), "education_signals": t.alias_groups(F.col(text), EDUCATION), "__e": experience(F.col(text))})
    df = df.withColumns({"experience_min": F.col("__e.low"), "experience_max": F.col("__e.high")})
    df = df.withColumns({"experience_label": experience_label(F.col("experience_min"), F.col("seniority_signals")), "analysis_confidence": confidence(F.length(F.coalesce(column, F.lit(""))), F.col("technologies"), F.col("experience_min"), F.col("seniority_signals"), F.col("education_signals"))})
    return df.drop(text, "__e")
