"""Stack detection: signals joined to files, the best confidence per technology kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import extension, glob_regex

# Manifest patterns (glob, build system, technology, confidence); the last three are wider names of the same manifests.
MANIFESTS = (
    ("pom.xml", "maven", "java", "HIGH"), ("build.gradle", "gradle", "java", "HIGH"), ("build.gradle.kts", "gradle", "kotlin/java", "HIGH"),
    ("package.json", "npm", "javascript", "MEDIUM"), ("angular.json", "angular", "angular", "HIGH"), ("requirements.txt", "pip", "python", "HIGH"),
    ("pyproject.toml", "python", "python", "HIGH"), ("Pipfile", "pipenv", "python", "HIGH"), ("go.mod", "go-modules", "go", "HIGH"),
    ("Cargo.toml", "cargo", "rust", "HIGH"), ("Gemfile", "bundler", "ruby", "HIGH"), ("composer.json", "composer", "php", "HIGH"),
    ("build.sbt", "sbt", "scala", "HIGH"), ("mix.exs", "mix", "elixir", "HIGH"), ("pubspec.yaml", "pub", "dart", "HIGH"),
    ("Package.swift", "spm", "swift", "HIGH"), ("*.csproj", "msbuild", "csharp", "HIGH"), ("*.sln", "msbuild", "csharp", "HIGH"),
    ("Dockerfile", "docker", "containers", "HIGH"), ("docker-compose.yml", "docker-compose", "containers", "HIGH"),
    ("docker-compose.prod.yml", "docker-compose", "containers", "HIGH"),
    ("requirements*.txt", "pip", "python", "HIGH"), ("docker-compose*.yml", "docker-compose", "containers", "HIGH"), ("tsconfig.json", None, "typescript", "HIGH"),
)
#: Files whose text is read for needles.
READ = (
    "package.json", "pom.xml", "requirements*.txt", "pyproject.toml", "go.mod", "Cargo.toml", "application.properties", "application.yml",
    "docker-compose*.yml", "*.csproj", "*.sln", "*Gemfile", "build.gradle*", "tsconfig.json", "Dockerfile", "angular.json",
)
# Needles (text, technology, role, confidence); the last two are further names in use here.
NEEDLES = (
    ("springframework", "spring-boot", "framework", "HIGH"), ("spring-boot", "spring-boot", "framework", "HIGH"), ("@angular/", "angular", "framework", "HIGH"),
    ("react", "react", "framework", "MEDIUM"), ("vue", "vue", "framework", "MEDIUM"), ("fastapi", "fastapi", "framework", "HIGH"),
    ("django", "django", "framework", "HIGH"), ("flask", "flask", "framework", "HIGH"), ("grpc", "grpc", "framework", "MEDIUM"),
    ("protobuf", "protobuf", "framework", "MEDIUM"), ("kafka", "kafka", "messaging", "MEDIUM"), ("flyway", "flyway", "migration-tool", "HIGH"),
    ("alembic", "alembic", "migration-tool", "HIGH"), ("typeorm", "typeorm", "orm", "MEDIUM"), ("prisma", "prisma", "orm", "MEDIUM"),
    ("sqlalchemy", "sqlalchemy", "orm", "MEDIUM"), ("hibernate", "hibernate/jpa", "orm", "HIGH"), ("keycloak", "keycloak", "auth", "MEDIUM"),
    ("jdbc:postgresql", "postgresql", "database", "HIGH"), ("jdbc:mysql", "mysql", "database", "HIGH"), ("jdbc:oracle", "oracle", "database", "HIGH"),
    ("postgresql", "postgresql", "database", "MEDIUM"), ("pg8000", "postgresql", "database", "MEDIUM"), ("psycopg", "postgresql", "database", "MEDIUM"),
    ("mysql", "mysql", "database", "MEDIUM"), ("mssql", "sql-server", "database", "MEDIUM"), ("sqlserver", "sql-server", "database", "MEDIUM"),
    ("sqlite", "sqlite", "database", "MEDIUM"), ("mongodb", "mongodb", "database", "MEDIUM"), ("pymongo", "mongodb", "database", "MEDIUM"),
    ("mongoose", "mongodb", "database", "MEDIUM"), ("redis", "redis", "cache", "MEDIUM"), ("memcached", "memcached", "cache", "MEDIUM"),
    ("aws-sdk", "aws", "cloud", "MEDIUM"), ("boto3", "aws", "cloud", "MEDIUM"), ("google-cloud", "gcp", "cloud", "MEDIUM"),
    ("kubernetes", "kubernetes", "infra", "MEDIUM"), ("terraform", "terraform", "infra", "MEDIUM"),
    ("spring-boot", "spring", "framework", "MEDIUM"), ("postgres", "postgresql", "database", "MEDIUM"),
)
EXTENSIONS = {
    ".java": "java", ".py": "python", ".go": "go", ".rs": "rust", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".dart": "dart", ".ex": "elixir", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".vue": "vue", ".svelte": "svelte", ".sql": "sql",
}
LANGUAGES = ("java", "python", "go", "rust", "ruby", "php", "scala", "elixir", "dart", "swift", "csharp", "kotlin/java", "javascript", "typescript")
SUPPORTED = ("java", "typescript", "javascript", "python", "go", "csharp", "rust", "sql", "vue", "svelte")
SECTIONS = dict.fromkeys(("framework", "orm", "migration-tool", "messaging"), "frameworks") | dict.fromkeys(("database", "cache"), "databases") | {"language": "languages"}
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def any_of(name: Column, globs: tuple[str, ...]) -> Column:
    return name.rlike("|".join(glob_regex(g) for g in globs))


def detect(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(section, name, confidence) from files (path, text or null). A technology stands in one
    section, that of its first signal of the best confidence; languages without an extractor also
    stand under unsupported."""
    base = F.element_at(F.split("path", "/"), -1)
    hits = []
    for glob, system, name, confidence in MANIFESTS:
        role = "language" if name in LANGUAGES else "framework" if name == "angular" else "tooling"
        test = any_of(base, (glob,)) | any_of(F.col("path"), (glob,))
        hits += [(test, name, role, confidence)] + ([(test, system, "build", confidence)] if system else [])
    low = F.when(any_of(base, READ), F.lower(F.coalesce("text", F.lit(""))))
    hits += [(low.contains(needle), name, role, confidence) for needle, name, role, confidence in NEEDLES]
    found = F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(SECTIONS.get(r, "infrastructure")).alias("section"), F.lit(n).alias("name"), F.lit(c).alias("confidence"), F.lit(-i).alias("o")))
        for i, (test, n, r, c) in enumerate(hits)
    ])
    # Most files are of no interest; one pattern tells that before the many tests.
    globs = tuple(dict.fromkeys([*(m[0] for m in MANIFESTS), *READ]))
    signals = files.where(any_of(base, globs) | any_of(F.col("path"), globs)).select(F.explode(F.array_compact(found)).alias("s")).select("s.section", "s.name", "s.confidence", "s.o")
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension(F.col("path")))
    census = files.select(lang.alias("name")).where("name IS NOT NULL").groupBy("name").count()
    census = census.select(F.lit("languages").alias("section"), "name", F.when(F.col("count") < 3, "LOW").otherwise("MEDIUM").alias("confidence"), F.lit(-len(hits)).alias("o"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence"))
    best = signals.unionByName(census).groupBy("name").agg(F.max_by(F.struct("section", "confidence"), F.struct(rank, "o")).alias("b"))
    missing = (F.col("b.section") == "languages") & ~F.col("name").isin(*SUPPORTED)
    both = F.array(F.col("b"), F.when(missing, F.struct(F.lit("unsupported").alias("section"), F.lit("LOW").alias("confidence"))))
    return best.select("name", F.explode(F.array_compact(both)).alias("r")).select("r.section", "name", "r.confidence")
