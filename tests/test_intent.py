"""Intent documents, bindings, migration, export and detection."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.operators import detect, intent, migrate

REQUIREMENTS = """# Product
## Core flows
### Flow 1 — Submit a claim
People file claims.
- [ ] A claim can be saved
- [x] A claim has an owner
## Data
| Entity | Fields |
| --- | --- |
| **Policy** | id |
## Non-goals
- Not building: **Chat** — too much
- Reopening of closed claims
- short
"""
PLAN = """## Data model
```
claim
  id PK
policy (seeded)
```
## Slices
### Slice 2 — First steps
Satisfies: Flow 1, flow 9
## Resolved forks
### SQL or not
Yes.
"""
DECISIONS = "### 2024-01-31 — Use queues\nBecause.\n**Deliberately not built:** Retries; Mails.\n"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("docs/requirements.md", REQUIREMENTS), ("docs/plan.md", PLAN), ("docs/decisions.md", DECISIONS)]
    n, e = intent.parse(spark.createDataFrame(rows, "path string, text string"))
    return n.cache(), e.cache()


def test_parse(parsed):
    n, e = parsed
    ids = {r["id"]: r for r in n.collect()}
    assert set(ids) == {
        "intent:capability:flow-1-submit-a-claim", "intent:requirement:flow-1-1-a-claim-can-be-saved", "intent:requirement:flow-1-2-a-claim-has-an-owner",
        "intent:concept:policy", "intent:concept:claim", "intent:non-goal:chat", "intent:non-goal:reopening-of-closed-claims",
        "intent:slice:slice-2-first-steps", "intent:concept:fork-sql-or-not", "intent:decision:2024-01-31-use-queues", "intent:non-goal:retries", "intent:non-goal:mails",
    }
    assert all(r["confidence"] is None and r["provenance"] == "asserted" for r in ids.values())
    assert ids["intent:capability:flow-1-submit-a-claim"]["body"].startswith("People file claims.\n- [ ]")
    assert {(r["src"], r["dst"], r["type"]) for r in e.collect()} == {
        ("intent:requirement:flow-1-1-a-claim-can-be-saved", "intent:capability:flow-1-submit-a-claim", "part-of"),
        ("intent:requirement:flow-1-2-a-claim-has-an-owner", "intent:capability:flow-1-submit-a-claim", "part-of"),
        ("intent:slice:slice-2-first-steps", "intent:capability:flow-1-submit-a-claim", "part-of"),
    }


def test_import_again_creates_nothing(parsed):
    n, e = parsed
    again = intent.upsert(n.withColumn("status", F.lit("needs-review")).withColumn("title", F.lit("old")), n)
    assert again.count() == n.count() and {r["status"] for r in again.collect()} == {"needs-review"}
    assert "old" not in {r["title"] for r in again.collect()}
    assert intent.insert_edges(e, e, n).count() == e.count()


def test_bindings_and_status(spark, parsed):
    n, e = parsed
    code = spark.createDataFrame([("py:function:save", "save", "a.py"), ("py:function:gone", "gone", "b.py")], "id string, name string, file string")
    target = n.where("kind = 'requirement'").limit(1).select("id", F.lit("realizes").alias("type"))
    bound = intent.bind(code, target, "it saves")
    edges = e.unionByName(bound, allowMissingColumns=True)
    nodes = n.unionByName(code.limit(1).withColumn("provenance", F.lit("derived")), allowMissingColumns=True)
    cap = "intent:capability:flow-1-submit-a-claim"
    assert {r["code"] for r in intent.responsible_for(edges, cap).collect()} == {"py:function:save", "py:function:gone"}
    marked = intent.mark_reviews(edges, nodes, spark.createDataFrame([("z.py",)], "path string"))
    assert {r["src"]: r["review_reason"] for r in marked.where("binding = 'manual'").collect()} == {"py:function:save": None, "py:function:gone": "code node vanished"}
    assert [(r["n_requirements"], r["n_code"], r["status"]) for r in intent.capabilities(nodes, marked).collect()] == [(2, 2, "stale")]
    assert [r["status"] for r in intent.capabilities(nodes, e.withColumn("review", F.lit(""))).collect()] == ["unbound"]
    assert intent.why(nodes, edges, "A.PY").count() == 1


def test_migration(spark):
    n = spark.createDataFrame([("a", "database-table", None), ("b", "class", "asserted")], "id string, kind string, provenance string")
    e = spark.createDataFrame([("a", "b", "stereotyped-as", None)], "src string, dst string, type string, provenance string")
    once = migrate.migrate(n, e)
    assert {tuple(r) for r in once[0].collect()} == {("a", "table", "derived"), ("b", "class", "asserted")}
    assert [r["type"] for r in once[1].collect()] == ["references"]
    assert {tuple(r) for r in migrate.migrate(*once)[0].collect()} == {tuple(r) for r in once[0].collect()}


def test_markdown_rows(spark):
    df = spark.createDataFrame([(i, "a|b" if i == 0 else "x") for i in range(5)], "id int, name string")
    rows = [r["row"] for r in migrate.markdown_rows(df, ["id", "name"], ["id"], cap=3).orderBy("place").collect()]
    assert rows[0] == "| id | name |" and rows[2] == "| 0 | a\\|b |" and len(rows) == 6 and rows[-1].startswith("| …and 2 more |")


def test_detect(spark):
    files = spark.createDataFrame([("pom.xml", "<spring-boot/> PostgreSQL"), ("src/A.java", None), ("src/b.py", None), ("c/docker-compose.dev.yml", "redis")], "path string, text string")
    got = {(r["section"], r["name"]): r["confidence"] for r in detect.detect(spark, files).collect()}
    assert got[("languages", "java")] == "HIGH" and got[("languages", "python")] == "LOW"
    assert got[("frameworks", "spring")] == "MEDIUM" and got[("databases", "postgresql")] == "MEDIUM" and got[("databases", "redis")] == "MEDIUM"


V1_KINDS = """record class, entity class, repository class, configuration configuration, configuration-key configuration-key, environment-variable environment,
frontend-component component, frontend-service service, frontend-route route, frontend-guard guard, frontend-interceptor interceptor, ts-class class,
test-case test-case, database-table table, database-view view, database-procedure procedure, database-sequence sequence, external-service external-service,
authentication configuration, deployment deployment-unit, ci-job ci-job, migration migration, file file"""
V1_TYPES = "stereotyped-as references, instantiates references, creates creates, modifies modifies, seeds seeds"


def test_every_old_name_migrates(spark):
    kinds, types = ([tuple(x.split()) for x in t.split(",")] for t in (V1_KINDS, V1_TYPES))
    n = spark.createDataFrame([(new, old, None) for old, new in kinds], "id string, kind string, provenance string")
    e = spark.createDataFrame([(new, "b", old, None) for old, new in types], "src string, dst string, type string, provenance string")
    once = migrate.migrate(n, e)
    assert [r["kind"] for r in once[0].collect()] == [new for _, new in kinds] and {new for _, new in kinds} <= set(S.NODE_KINDS)
    assert [r["type"] for r in once[1].collect()] == [new for _, new in types] and {new for _, new in types} <= set(S.EDGE_TYPES)
    assert [r["kind"] for r in migrate.migrate(*once)[0].collect()] == [new for _, new in kinds]
    later = migrate.migrate(n, e, version=2)
    assert [r["kind"] for r in later[0].collect()] == [old for old, _ in kinds] and {r["provenance"] for r in later[0].collect()} == {"derived"}


# File, section, name, confidence.
MANIFESTS = """pom.xml languages java HIGH, build.gradle languages java HIGH, build.gradle.kts languages kotlin/java HIGH, package.json languages javascript MEDIUM,
angular.json frameworks angular HIGH, requirements.txt languages python HIGH, pyproject.toml languages python HIGH, Pipfile languages python HIGH, go.mod languages go HIGH,
Cargo.toml languages rust HIGH, Gemfile languages ruby HIGH, composer.json languages php HIGH, build.sbt languages scala HIGH, mix.exs languages elixir HIGH,
pubspec.yaml languages dart HIGH, Package.swift languages swift HIGH, a.csproj languages csharp HIGH, a.sln languages csharp HIGH, Dockerfile infrastructure containers HIGH,
docker-compose.yml infrastructure containers HIGH, docker-compose.prod.yml infrastructure containers HIGH, pom.xml infrastructure maven HIGH, build.gradle infrastructure gradle HIGH,
build.gradle.kts infrastructure gradle HIGH, package.json infrastructure npm MEDIUM, requirements.txt infrastructure pip HIGH, Pipfile infrastructure pipenv HIGH,
go.mod infrastructure go-modules HIGH, Cargo.toml infrastructure cargo HIGH, Gemfile infrastructure bundler HIGH, composer.json infrastructure composer HIGH,
build.sbt infrastructure sbt HIGH, mix.exs infrastructure mix HIGH, pubspec.yaml infrastructure pub HIGH, Package.swift infrastructure spm HIGH, a.csproj infrastructure msbuild HIGH,
a.sln infrastructure msbuild HIGH, Dockerfile infrastructure docker HIGH, docker-compose.yml infrastructure docker-compose HIGH, docker-compose.prod.yml infrastructure docker-compose HIGH"""
NEEDLES = """springframework frameworks spring-boot HIGH, spring-boot frameworks spring-boot HIGH, @angular/ frameworks angular HIGH, react frameworks react MEDIUM,
vue frameworks vue MEDIUM, fastapi frameworks fastapi HIGH, django frameworks django HIGH, flask frameworks flask HIGH, grpc frameworks grpc MEDIUM,
protobuf frameworks protobuf MEDIUM, kafka frameworks kafka MEDIUM, flyway frameworks flyway HIGH, alembic frameworks alembic HIGH, typeorm frameworks typeorm MEDIUM,
prisma frameworks prisma MEDIUM, sqlalchemy frameworks sqlalchemy MEDIUM, hibernate frameworks hibernate/jpa HIGH, keycloak infrastructure keycloak MEDIUM,
jdbc:postgresql databases postgresql HIGH, jdbc:mysql databases mysql HIGH, jdbc:oracle databases oracle HIGH, postgresql databases postgresql MEDIUM,
pg8000 databases postgresql MEDIUM, psycopg databases postgresql MEDIUM, mysql databases mysql MEDIUM, mssql databases sql-server MEDIUM, sqlserver databases sql-server MEDIUM,
sqlite databases sqlite MEDIUM, mongodb databases mongodb MEDIUM, pymongo databases mongodb MEDIUM, mongoose databases mongodb MEDIUM, redis databases redis MEDIUM,
memcached databases memcached MEDIUM, aws-sdk infrastructure aws MEDIUM, boto3 infrastructure aws MEDIUM, google-cloud infrastructure gcp MEDIUM,
kubernetes infrastructure kubernetes MEDIUM, terraform infrastructure terraform MEDIUM"""
SOURCES = """.java java, .py python, .go go, .rs rust, .cs csharp, .rb ruby, .php php, .swift swift, .kt kotlin, .scala scala, .dart dart, .ex elixir, .ts typescript,
.tsx typescript, .js javascript, .jsx javascript, .vue vue, .svelte svelte, .sql sql"""


def detected(spark, files):
    return {(r["section"], r["name"]): r["confidence"] for r in detect.detect(spark, spark.createDataFrame(files, "path string, text string")).collect()}


def rounds(entries):
    """The entries in groups that name each technology once."""
    out = []
    for e in entries:
        group = next((g for g in out if all(e[2] != x[2] for x in g)), None)
        out.append([e]) if group is None else group.append(e)
    return out


def test_every_signal_is_detected(spark):
    for group in rounds([x.split() for x in MANIFESTS.split(",")]):
        got = detected(spark, [(f"m/{file}", None) for file in {e[0] for e in group}])
        assert {(s, n): got.get((s, n)) for _, s, n, _ in group} == {(s, n): c for _, s, n, c in group}
    for group in rounds([x.split() for x in NEEDLES.split(",")]):
        got = detected(spark, [("application.yml", "\n".join(e[0] for e in group).upper())])
        assert {(s, n): got.get((s, n)) for _, s, n, _ in group} == {(s, n): c for _, s, n, c in group}
    for group in rounds([("", *x.split()[:1], *x.split()[1:]) for x in SOURCES.split(",")]):
        few = detected(spark, [(f"s/a{e[1]}", None) for e in group])
        assert {k: c for k, c in few.items() if k[0] == "languages"} == {("languages", e[2]): "LOW" for e in group}
        assert {n for s, n in few if s == "unsupported"} == {e[2] for e in group} & {"ruby", "php", "swift", "kotlin", "scala", "dart", "elixir"}
    many = detected(spark, [(f"s/{i}.vue", None) for i in range(3)] + [("package.json", "vue")])
    assert many["frameworks", "vue"] == "MEDIUM" and ("languages", "vue") not in many
