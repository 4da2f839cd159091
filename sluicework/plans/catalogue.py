"""QUERIES and SQL: every kernel over whole tables, with the same result in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comments as C
from ..functions import identity as I
from ..functions import paths as P
from ..operators import clones, diff, graph, health, lines, report
from .. import reporters
from ..session import placed
from ..sources import config, project
from . import generated  # noqa: F401  its queries register themselves
from . import rules as R
from . import runner
from .registry import QUERIES, SQL, query  # noqa: F401

# identity


@query("SELECT o_orderkey, substr(sha256(o_orderpriority || chr(0) || o_orderstatus || chr(0) || o_orderkey), 1, 16) AS fingerprint FROM orders")
def q_fingerprint(t):
    fp = I.fingerprint(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    return t("orders").select("o_orderkey", fp.alias("fingerprint"))


@query("SELECT 'ruleset@' || substr(sha256(string_agg(DISTINCT event_type, chr(10) ORDER BY event_type)), 1, 8) AS version FROM events")
def q_ruleset_version(t):
    return t("events").agg(I.ruleset_version(F.col("event_type")).alias("version"))


# paths


def _path():
    return F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path")


_SQL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(f"SELECT page_id, path FROM (SELECT page_id, {_SQL_PATH} AS path FROM pages) WHERE len(string_split(path, '/')) > 1 AND string_split(path, '/')[1] IN ('en', 'fr')")
def q_scope_filter(t):
    return t("pages").select("page_id", _path()).where(P.in_dirs(F.col("path"), ("en", "fr")))


@query(
    f"""SELECT page_id, path, ends_with(name, '7.html') OR ends_with(name, '9') OR (starts_with(name, '4') AND ends_with(name, '.html')) AS is_generated
FROM (SELECT page_id, path, string_split(path, '/')[-1] AS name FROM (SELECT page_id, {_SQL_PATH} AS path FROM pages))"""
)
def q_generated_predicate(t):
    made = P.generated(F.col("path"), ("7.html", "9"), "4", ".html")
    return t("pages").select("page_id", _path()).withColumn("is_generated", made)


GLOBS = ("en/7*", "fr/**", "**/9*.html", "{de,es}/?1*")


@query(
    f"SELECT page_id, path FROM (SELECT page_id, {_SQL_PATH} AS path FROM pages) WHERE NOT ("
    + " OR ".join(f"regexp_matches(path, '{P.glob_regex(g)}')" for g in GLOBS)
    + ")"
)
def q_glob_suppress(t):
    return t("pages").select("page_id", _path()).where(~P.matches_any(F.col("path"), GLOBS))


@query(
    f"""SELECT page_id, own FROM (SELECT page_id, CASE WHEN starts_with(path, 'en/1') THEN 'lib/src/' WHEN starts_with(path, 'en/') THEN 'lib/' ELSE 'bin/' END || path AS own
FROM (SELECT page_id, {_SQL_PATH} AS path FROM pages)) WHERE NOT (starts_with(own, 'lib/') AND NOT starts_with(own, 'lib/src/'))"""
)
def q_publishable(t):
    p = F.col("path")
    own = F.concat(F.when(p.startswith("en/1"), "lib/src/").when(p.startswith("en/"), "lib/").otherwise("bin/"), p)
    return t("pages").select("page_id", _path()).select("page_id", own.alias("own")).where(~P.public_api(F.col("own")))


# lines and order


@query("SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def q_line_index(t):
    return lines.lines(t("documents").where("text is not null"), ["doc_id"], "text").select("doc_id", F.col("line_no").cast("long"), "line")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
p AS (SELECT *, coalesce(lag(regexp_matches(line, '^\s*(Th|En|De|Le)')) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS justified FROM l)
SELECT doc_id, line_no FROM p WHERE NOT justified AND regexp_matches(line, '^\s*(Er|On|An)')"""
)
def q_previous_line(t):
    rows = lines.lines(t("documents").where("text is not null"), ["doc_id"], "text")
    rows = lines.with_previous(rows, ["doc_id"], "line_no", F.col("line").rlike(r"^\s*(Th|En|De|Le)"), "justified")
    return rows.where(~F.col("justified") & F.col("line").rlike(r"^\s*(Er|On|An)")).select("doc_id", F.col("line_no").cast("long"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def q_occurrence_index(t):
    return lines.with_occurrence(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", F.col("occurrence").cast("long"))


@query(
    """WITH d AS (SELECT l_orderkey, l_returnflag, l_linenumber FROM lineitem WHERE l_quantity < 8)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem f WHERE NOT EXISTS (
  SELECT 1 FROM d WHERE d.l_orderkey = f.l_orderkey AND d.l_returnflag = f.l_returnflag AND f.l_linenumber BETWEEN d.l_linenumber AND d.l_linenumber + 1)"""
)
def q_inline_suppress(t):
    rows = t("lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_quantity")
    return diff.band_anti(rows, rows.where("l_quantity < 8"), ["l_orderkey", "l_returnflag"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT n_regionkey, string_agg('r' || n_nationkey % 4 || '=' || CASE WHEN (n_nationkey % 3 = 0) = first THEN 'true' ELSE 'false' END, ',' ORDER BY n_nationkey % 4) AS rules, any_value(ignored) AS ignored, any_value(dirs) AS dirs
FROM (SELECT n_regionkey, n_nationkey, TRUE AS first, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 4 ORDER BY n_nationkey DESC) AS back,
        string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ignored,
        coalesce('d' || max(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) OVER (PARTITION BY n_regionkey), 'lib,bin') AS dirs FROM nation)
WHERE back = 1 GROUP BY n_regionkey"""
)
def q_config_layers(t):
    """Each region's nations are the layers of a configuration; the table has as many rows at every size."""
    layers: dict[int, list[str]] = {}
    for r in t("nation").orderBy("n_nationkey").collect():
        k = r.n_nationkey
        layers.setdefault(r.n_regionkey, []).append(f"rules:\n  r{k % 4}: {'true' if k % 3 == 0 else 'false'}\nignore: ['{r.n_name}']\n" + (f"source_dirs:\n- d{k}/sub\n" if k % 2 == 0 else ""))
    rows = []
    for region, texts in sorted(layers.items()):
        c = config.merge([config.parse(x) for x in texts], {f"r{n}" for n in range(4)})
        rows.append((region, ",".join(f"{k}={str(v).lower()}" for k, v in sorted(c.rules.items())), ",".join(c.ignore), ",".join(c.source_dirs)))
    return t("nation").sparkSession.createDataFrame(rows, "n_regionkey int, rules string, ignored string, dirs string")


@query(
    r"""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'build_runner' WHEN c_nationkey % 3 = 1 THEN 'build_runner,freezed' ELSE '' END AS generators, c_nationkey % 2 = 0 AS is_flutter, c_nationkey % 5 <> 0 AS is_publishable FROM customer"""
)
def q_stack_profile(t):
    """Manifests of all kinds; a generator among the plain dependencies, or Flutter in the environment, doesn't count."""
    k = F.col("c_nationkey")
    tools = F.when(k % 3 == 0, "dev_dependencies:\n  build_runner: ^2.0.0\n").when(k % 3 == 1, "dev_dependencies: {freezed: any, 'build_runner': ^2.0.0, lints: any}\n").otherwise("environment:\n  flutter: '>=3.0.0'\n")
    uses = F.when(k % 2 == 0, "dependencies:\n  flutter:\n    sdk: flutter\n  mockito: any\n").otherwise("dependencies:\n  source_gen: any # not for tests\n")
    manifest = F.concat(F.lit("name: p"), F.col("c_custkey").cast("string"), F.lit("\n"), F.when(k % 5 == 0, "publish_to: 'none'\n").otherwise(""), uses, tools)
    return project.profiles(t("customer").select("c_custkey", manifest.alias("manifest")), "c_custkey", "manifest").select("c_custkey", "generators", "is_flutter", "is_publishable")


# clones


@query(
    """SELECT sha256(text) AS digest, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS locations, min(length(text)) AS chars
FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) >= 2"""
)
def q_exact_clones(t):
    found = clones.exact_clusters(t("documents"), F.col("text"), F.col("doc_id"), {"chars": F.min(F.length("text")).cast("long")})
    return found.withColumn("locations", F.concat_ws(",", F.col("locations").cast("array<string>")))


def word_kind(word: str) -> tuple[str, str]:
    """Words of letters are names here, numbers are literals."""
    plain = word.isascii()
    return "lit" if plain and word.isdigit() else "id" if plain and word.isalpha() else "other", word


@query(
    r"""WITH w AS (SELECT doc_id, unnest(range(0, len(l))) AS seq, unnest(l) AS lexeme FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents WHERE text IS NOT NULL)),
k AS (SELECT *, CASE WHEN regexp_matches(lexeme, '^[0-9]+$') THEN 'lit' WHEN regexp_matches(lexeme, '^[A-Za-z]+$') THEN 'id' ELSE 'other' END AS kind FROM w),
f AS (SELECT doc_id, kind, lexeme, row_number() OVER (PARTITION BY doc_id, kind ORDER BY min(seq)) - 1 AS slot FROM k WHERE kind <> 'other' GROUP BY doc_id, kind, lexeme),
x AS (SELECT k.doc_id, seq, CASE WHEN f.slot IS NULL THEN k.lexeme ELSE chr(1) || k.kind || f.slot END AS t FROM k LEFT JOIN f ON k.doc_id = f.doc_id AND k.kind = f.kind AND k.lexeme = f.lexeme),
b AS (SELECT doc_id, count(*) AS token_count, string_agg(t, chr(31) ORDER BY seq) AS s FROM x GROUP BY doc_id HAVING count(*) >= 50 AND count(DISTINCT t) >= 8)
SELECT sha256(s) AS digest, token_count, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS blocks FROM b GROUP BY s, token_count HAVING count(*) >= 2"""
)
def q_renamed_clones(t):
    words = t("documents").where("text is not null").select("doc_id", F.split("text", " ", -1).alias("items"))
    found = clones.renamed_clusters(words, ["doc_id"], kind_of=word_kind)
    return found.select("digest", F.col("token_count").cast("long"), F.size("blocks").cast("long").alias("n"), F.concat_ws(",", F.col("blocks.doc_id").cast("array<string>")).alias("blocks"))


# graph

_SQL_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src,
  lead(o_custkey) OVER (PARTITION BY o_orderpriority, c_nationkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders JOIN customer ON o_custkey = c_custkey) WHERE src <> dst)"""


def order_edges(t):
    """From each order's customer to that of the next order of the same priority and nation."""
    from pyspark.sql.window import Window

    rows = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    dst = F.lead("o_custkey").over(Window.partitionBy("o_orderpriority", "c_nationkey").orderBy("o_orderdate", "o_orderkey"))
    return graph.clean_edges(rows.select(F.col("o_custkey").alias("src"), dst.alias("dst")))


@query(f"WITH {_SQL_EDGES} SELECT src, dst FROM e")
def q_import_edges(t):
    return order_edges(t)


@query(
    f"""WITH RECURSIVE {_SQL_EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT root, string_agg(node, ',' ORDER BY node) AS members, count(*) AS n, CASE WHEN count(*) = 2 THEN 'bidirectional-cycle' ELSE 'multi-file-cycle' END AS kind
FROM m GROUP BY root HAVING count(*) >= 2"""
)
def q_cycles(t):
    return graph.cycles(order_edges(t)).withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query(
    """WITH RECURSIVE e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT r_name, 'WORLD' FROM region UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c(src, dst) AS (SELECT * FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c"""
)
def q_supertype_closure(t):
    nation, region = t("nation"), t("region")
    e = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    e = e.union(region.select("r_name", F.lit("WORLD"))).union(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name"))
    return graph.closure(e)


# joins


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 45) AND p_brand <> 'Brand#4'")
def q_unused(t):
    used = t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return diff.unused(t("part").where("p_brand <> 'Brand#4'").select("p_partkey", "p_name"), used, key="p_partkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND c_mktsegment <> 'BUILDING'")
def q_unused_customers(t):
    return diff.unused(t("customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), key="c_custkey")


@query(
    """SELECT DISTINCT element FROM (SELECT o_custkey AS element FROM orders UNION ALL
SELECT c_nationkey * 1000000 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"""
)
def q_enclosing_liveness(t):
    members = t("customer").select(F.col("c_custkey").alias("element"), (F.col("c_nationkey").cast("long") * 1000000).alias("owner"))
    return R.with_owners(t("orders").select(F.col("o_custkey").alias("element")), members, "element", "owner")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'take it back' WHEN 'A' THEN 'accept it' ELSE 'look at it' END AS hint FROM lineitem")
def q_fix_hint(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", report.hint(F.col("l_returnflag"), {"R": "take it back", "A": "accept it"}, "look at it").alias("hint"))


@query("SELECT p_type, count(*) AS n FROM part WHERE split_part(p_type, ' ', 1) IN ('STANDARD', 'ECONOMY', 'PROMO') AND p_type NOT LIKE '%STEEL' GROUP BY p_type")
def q_category_toggle(t):
    """Part types as rules, their first words as categories; those of steel are switched off. There are 150 types at most."""
    kinds = sorted(r.p_type for r in t("part").select("p_type").distinct().collect())
    registry = [(x, x.split(" ")[0].lower(), "info") for x in kinds]
    off = config.Config(rules={x: False for x in kinds if x.endswith("STEEL")})
    chosen = [x for c in ("standard", "economy", "promo") for x in runner.active(off, c, registry)]
    return t("part").where(F.col("p_type").isin(*chosen)).groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40)
SELECT d.l_orderkey, d.l_linenumber, max_by(c.l_quantity, c.l_linenumber) AS comment FROM lineitem d JOIN c ON c.l_orderkey = d.l_orderkey AND c.l_linenumber = d.l_linenumber - 1
GROUP BY d.l_orderkey, d.l_linenumber"""
)
def q_comment_adjacency(t):
    """A line may occur twice in an order: of equal numbers the table's last row counts, as in the SQL."""
    rows = placed(t("lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", "place")
    above = rows.where("l_quantity > 40").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_linenumber").alias("at"), "place", F.col("l_quantity").alias("comment"))
    key = ["l_orderkey", "l_linenumber"]
    return lines.last_by(above, key, ["at", "place"], ["comment"]).join(rows.select(*key), key, "left_semi")


# complexity

_SQL_METRICS = """m AS (SELECT o_orderkey, o_custkey, CAST(1 + count(l_orderkey) AS INT) AS cyclomatic,
  CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 0) AS INT) AS cognitive
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey)"""


def _metrics(t):
    points = t("lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("cyc"), (F.col("l_returnflag") != "N").cast("int").alias("cog"), (F.col("l_returnflag") == "R").alias("nested"), (F.col("l_linenumber") - 1).alias("depth")
    )
    return health.metrics(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), points, ["o_orderkey"])


@query(f"WITH {_SQL_METRICS} SELECT o_orderkey, cyclomatic, cognitive FROM m")
def q_complexity(t):
    return _metrics(t).select("o_orderkey", "cyclomatic", "cognitive")


@query(
    f"""WITH {_SQL_METRICS} SELECT o_orderkey, concat_ws(', ', CASE WHEN cyclomatic > 5 THEN 'cyclomatic ' || cyclomatic || ' > 5' END,
  CASE WHEN cognitive > 9 THEN 'cognitive ' || cognitive || ' > 9' END) AS breach
FROM m WHERE NOT (cyclomatic <= 1 AND cognitive = 0) AND (cognitive > 9 OR (cyclomatic > 5 AND cognitive > 2))"""
)
def q_hotspots(t):
    return health.hotspots(_metrics(t), cyc_max=5, cog_max=9, cog_floor=2).select("o_orderkey", "breach")


_SQL_HEALTH = """SELECT {by} n, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT {by} count(*) AS n, CAST(least(greatest(round(100 * (1 - coalesce(sum(least(greatest(greatest(cyclomatic, cognitive) - 10, 0), 40)) / (count(*) * 40), 0))), 0), 100) AS INT) AS score FROM {src})"""


@query(f"WITH {_SQL_METRICS} " + _SQL_HEALTH.format(by="", src="m"))
def q_health(t):
    return health.health(_metrics(t))


@query(f"WITH {_SQL_METRICS}, s AS (SELECT m.*, c_mktsegment FROM m JOIN customer ON o_custkey = c_custkey) " + _SQL_HEALTH.format(by="c_mktsegment,", src="s GROUP BY c_mktsegment"))
def q_health_by_segment(t):
    rows = _metrics(t).join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return health.health(rows, ["c_mktsegment"])


@query(f"WITH {_SQL_METRICS} SELECT o_orderkey, greatest(cyclomatic, cognitive) AS magnitude FROM m ORDER BY magnitude DESC, o_orderkey LIMIT 20")
def q_worst(t):
    return health.worst(_metrics(t), order=("o_orderkey",)).select("o_orderkey", "magnitude")


# baseline and gate

_SQL_FP = "substr(sha256(event_type || chr(0) || user_id || chr(0) || CAST(floor(value / 10) AS BIGINT)), 1, 16)"
_SQL_DIFF = f"""c AS (SELECT event_id, {_SQL_FP} AS fingerprint FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
b AS (SELECT event_id, {_SQL_FP} AS fingerprint FROM events WHERE ts < TIMESTAMP '2024-01-20'),
d AS (SELECT *, CASE WHEN fingerprint IN (SELECT fingerprint FROM b) THEN 'kept' ELSE 'new' END AS status FROM c
  UNION ALL SELECT *, 'fixed' FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM c))"""


def _diff(t):
    fp = I.fingerprint(F.col("event_type"), F.col("user_id").cast("string"), F.floor(F.col("value") / 10).cast("string"))
    rows = t("events").where("value is not null and event_type is not null and user_id is not null").select("event_id", "ts", fp.alias("fingerprint"))
    return diff.baseline_diff(rows.where("ts >= timestamp '2024-01-10'").drop("ts"), rows.where("ts < timestamp '2024-01-20'").drop("ts"))


@query(f"WITH {_SQL_DIFF} SELECT event_id, fingerprint, status FROM d")
def q_baseline_diff(t):
    return _diff(t).select("event_id", "fingerprint", "status")


@query(f"WITH {_SQL_DIFF} SELECT count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status = 'kept') AS kept_count, count(*) FILTER (status = 'fixed') AS fixed_count, count(*) FILTER (status = 'new') = 0 AS passed FROM d")
def q_gate_ratchet(t):
    return diff.ratchet(_diff(t))


@query("SELECT count(*) AS total, count(*) <= 100 AS passed FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09")
def q_gate_absolute(t):
    return diff.absolute(t("lineitem").where("l_quantity = 50 and l_discount > 0.09"), 100)


# reports


def _severity():
    return F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("purchase", "signup"), "warning").otherwise("info")


_SQL_SEVERITY = "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase', 'signup') THEN 'warning' ELSE 'info' END"


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'info') AS info FROM (SELECT {_SQL_SEVERITY} AS s FROM events)")
def q_severity_summary(t):
    return report.severity_summary(t("events").withColumn("severity", _severity()))


@query(f"SELECT event_id, CASE s WHEN 'info' THEN 'note' ELSE s END AS level FROM (SELECT event_id, {_SQL_SEVERITY} AS s FROM events)")
def q_sarif_levels(t):
    return t("events").select("event_id", report.sarif_level(_severity()).alias("level"))


@query("SELECT event_type, row_number() OVER (ORDER BY min((ts, event_id))) - 1 AS rule_index FROM events GROUP BY event_type")
def q_rule_catalogue(t):
    return report.catalogue(t("events"), "event_type", ["ts", "event_id"]).select("event_type", F.col("rule_index").cast("long"))


@query("SELECT count(*) AS files, count(*) FILTER (lang = 'en') AS lib_files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents")
def q_scan_stats(t):
    count = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)))
    return runner.scan_stats(t("documents"), F.col("lang") == "en", count)


_SQL_FOUND = f"""f AS (SELECT event_type AS rule_id, {_SQL_SEVERITY} AS severity, 'u/' || user_id || '.dart' AS file_path, CAST(event_id % 5000 AS INT) AS line, CASE WHEN event_type <> 'view' THEN CAST(event_id % 80 AS INT) END AS col,
  'a|b ' || props AS message, CASE WHEN event_id % 3 > 0 THEN 'k' || event_id % 3 END AS kind, CASE WHEN event_type <> 'click' THEN 'fix it' END AS remedy,
  CASE WHEN event_type = 'purchase' THEN {{'number': '1.1.1', 'title': 'Text'}} END AS wcag, substr(sha256(event_type || chr(0) || user_id || chr(0) || event_id), 1, 16) AS fingerprint FROM events)"""


def findings(t):
    """Findings out of events."""
    k, kind = F.col("event_id"), F.col("event_type")
    wcag = F.when(kind == "purchase", F.struct(F.lit("1.1.1").alias("number"), F.lit("Text").alias("title")))
    return t("events").select(
        kind.alias("rule_id"), _severity().alias("severity"), F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".dart")).alias("file_path"), (k % 5000).cast("int").alias("line"),
        F.when(kind != "view", (k % 80).cast("int")).alias("column"), F.concat(F.lit("a|b "), F.col("props")).alias("message"), F.when(k % 3 > 0, F.concat(F.lit("k"), (k % 3).cast("string"))).alias("kind"),
        F.when(kind != "click", "fix it").alias("remedy"), wcag.alias("wcag"), I.fingerprint(kind, F.col("user_id").cast("string"), k.cast("string")).alias("fingerprint"),
    )


@query(
    rf"""WITH {_SQL_FOUND} SELECT file_path, count(*) AS n, string_agg('| ' || line || ' | ' || severity || ' | ' || rule_id || ' | ' || replace(message, '|', '\|') || ' | ' || coalesce(remedy, '—') || ' |',
  chr(10) ORDER BY line, fingerprint) AS text FROM f GROUP BY file_path"""
)
def q_markdown_tables(t):
    return reporters.markdown_blocks(findings(t))


@query(
    f"""WITH {_SQL_FOUND}, p AS (SELECT *, line || coalesce(':' || col, '') AS place FROM f)
SELECT file_path, count(*) AS n, string_agg('  ' || CASE WHEN length(place) < 8 THEN rpad(place, 8, ' ') ELSE place END || ' ' || severity || '  ' || rule_id || '  ' || message
  || CASE WHEN wcag IS NULL THEN '' ELSE ' (WCAG 1.1.1 Text)' END, chr(10) ORDER BY line, fingerprint) AS text FROM p GROUP BY file_path"""
)
def q_human_report(t):
    return reporters.human_blocks(findings(t))


@query(f"WITH {_SQL_FOUND} SELECT string_agg('* ' || file_path || ':' || line || ' (' || rule_id || '): ' || message || chr(10) || '  Hint: Fix the finding without changing behaviour.', chr(10) || chr(10) ORDER BY file_path, line, fingerprint) AS text FROM f")
def q_fix_prompt(t):
    return reporters.prompt_text(findings(t))


@query(
    f"""WITH {_SQL_FOUND}, r AS (SELECT rule_id, row_number() OVER (ORDER BY min((file_path, line, fingerprint))) - 1 AS i FROM f GROUP BY rule_id)
SELECT fingerprint, '{{"ruleId":"' || f.rule_id || '","ruleIndex":' || i || ',"level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '","message":' || to_json({{'text': message}})
  || ',"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file_path || '"}},"region":{{"startLine":' || greatest(1, line) || coalesce(',"startColumn":' || col, '') || '}}}}}}],"partialFingerprints":{{"sluicework/v1":"' || fingerprint || '"}}'
  || CASE WHEN kind IS NULL AND remedy IS NULL AND wcag IS NULL THEN '' ELSE ',"properties":{{' || concat_ws(',', '"kind":"' || kind || '"', '"remedy":"' || remedy || '"', CASE WHEN wcag IS NOT NULL THEN '"wcag":{{"number":"1.1.1","title":"Text"}}' END) || '}}' END || '}}' AS result
FROM f JOIN r ON f.rule_id = r.rule_id"""
)
def q_sarif_results(t):
    return reporters.sarif_results(findings(t))[1].select("fingerprint", "result")


@query("SELECT facet, value, count(*) AS n FROM (SELECT unnest(['returnflag', 'linestatus', 'line']) AS facet, unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS value FROM lineitem) GROUP BY ALL")
def q_facets(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_linenumber").alias("line"))
    return report.facet_counts(rows, ["returnflag", "linestatus", "line"])


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'standard')")
def q_report_search(t):
    return report.search(t("part"), "StandARD", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query(f"WITH {_SQL_FOUND} SELECT file_path, line, fingerprint FROM f ORDER BY file_path, line, fingerprint")
def q_total_order(t):
    return reporters.ordered(findings(t)).select("file_path", "line", "fingerprint")


@query(
    f"""WITH {_SQL_FOUND} SELECT fingerprint, CASE WHEN wcag IS NULL THEN body ELSE left(body, length(body) - 1) || ',"wcagRef":{{"number":"1.1.1","title":"Text"}}}}' END AS finding FROM (SELECT fingerprint, wcag,
  CAST(to_json({{'ruleId': rule_id, 'severity': severity, 'filePath': file_path, 'line': line, 'column': col, 'message': message, 'kind': kind, 'remedy': remedy, 'fingerprint': fingerprint}}) AS VARCHAR) AS body FROM f)"""
)
def q_json_findings(t):
    return findings(t).select("fingerprint", report.json_finding().alias("finding"))


@query(f"WITH {_SQL_FOUND} SELECT count(*) || ' findings (error: ' || count(*) FILTER (severity = 'error') || ', warning: ' || count(*) FILTER (severity = 'warning') || ', info: ' || count(*) FILTER (severity = 'info') || ')' AS text FROM f")
def q_breakdown_text(t):
    return report.summary_line(findings(t))


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) < 38 THEN rpad(p_name, 38, ' ') ELSE p_name END || CASE WHEN length(p_brand || ':' || p_size) < 30 THEN rpad(p_brand || ':' || p_size, 30, ' ') ELSE p_brand || ':' || p_size END
  || lpad(CAST(p_size AS VARCHAR), 5, ' ') || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 5 THEN lpad(CAST(p_partkey AS VARCHAR), 5, ' ') ELSE CAST(p_partkey AS VARCHAR) END AS text FROM part"""
)
def q_health_table(t):
    rows = t("part").select("p_partkey", F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"), F.col("p_size").alias("cyclomatic"), F.col("p_partkey").alias("cognitive"))
    return reporters.health_lines(rows).select("p_partkey", "text")


# comments


@query(
    r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('//  ' || p_name || ' !. ;'), '^\s*//', ''), '^\s+', ''), '[.,:;!\s]+$', '') AS comment FROM part"""
)
def q_comment_normalize(t):
    return t("part").select("p_partkey", C.normal_comment(F.concat(F.lit("//  "), F.col("p_name"), F.lit(" !. ;"))).alias("comment"))


@query(
    r"""SELECT event_id, regexp_extract(line, '//\s*(ignore(?:_for_file)?)\s*:(.*)', 1) AS kind, list_aggregate(list_sort(list_transform(string_split(trim(regexp_extract(rest, '^\s*([A-Za-z][A-Za-z0-9_]*(?:\s*,\s*[A-Za-z][A-Za-z0-9_]*)*)', 1)), ','), lambda x: trim(x))), 'string_agg', ',') AS lints
FROM (SELECT event_id, line, regexp_extract(line, '//\s*(ignore(?:_for_file)?)\s*:(.*)', 2) AS rest FROM
 (SELECT event_id, '  // ' || CASE WHEN event_type = 'click' THEN 'ignore_for_file' ELSE 'ignore' END || ': ' || event_type || ' , b' || user_id || ',a_x' AS line FROM events))"""
)
def q_lint_normalize(t):
    kind = F.when(F.col("event_type") == "click", "ignore_for_file").otherwise("ignore")
    line = F.concat(F.lit("  // "), kind, F.lit(": "), F.col("event_type"), F.lit(" , b"), F.col("user_id").cast("string"), F.lit(",a_x"))
    rows = t("events").select("event_id", line.alias("line"))
    return rows.select("event_id", C.ignore_kind(F.col("line")).alias("kind"), C.lint_names(F.regexp_extract("line", C.IGNORE, 2)).alias("lints"))


@query(
    r"""SELECT event_id, CASE WHEN why <> '' THEN event_type END AS rule FROM (SELECT event_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN '' ELSE props END AS why FROM events)"""
)
def q_directive_parse(t):
    why = F.when(F.col("event_type").isin("view", "click"), "").otherwise(F.col("props"))
    lexeme = F.concat(F.lit(C.DIRECTIVE + " "), F.col("event_type"), F.lit(" - "), why)
    return t("events").select("event_id", C.directive_rule(lexeme).alias("rule"))


# classification


@query(
    """SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'base type View' WHEN p_brand IN ('Brand#2', 'Brand#17') THEN 'annotation freezed' WHEN p_size > 40 AND p_type LIKE '%UM' THEN 'generated part' END AS reason FROM part"""
)
def q_codegen_case(t):
    supers = F.array(F.when(F.col("p_type").startswith("ECONOMY"), "View").when(F.col("p_type").endswith("UM"), F.concat(F.lit("_$"), F.col("p_name"))).otherwise(F.col("p_name")), F.lit("Object"))
    notes = F.array(F.when(F.col("p_brand").isin("Brand#2", "Brand#17"), "freezed").otherwise("override"))
    return t("part").select("p_partkey", R.codegen_reason(supers, notes, F.col("p_size") > 40).alias("reason"))


@query(
    """SELECT l_orderkey, l_linenumber FROM lineitem n WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = n.l_orderkey
 AND a.l_linestatus = 'O' AND a.l_linenumber < n.l_linenumber AND a.l_linenumber + 3 > n.l_linenumber)"""
)
def q_ancestor_label(t):
    k = F.col("l_linenumber")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    inner = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", k.alias("pre"), k.alias("post"))
    outer = rows.where("l_linestatus = 'O'").select("l_orderkey", k.alias("pre"), (k + 3).alias("post"))
    return lines.outside(inner, outer, ["l_orderkey"], "pre", "post").select("l_orderkey", "l_linenumber")


@query(
    """SELECT p_partkey FROM part WHERE p_name <> '' AND NOT starts_with(p_name, '_') AND p_name <> 'main' AND p_brand <> 'Brand#3' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48 AND l_partkey IS NOT NULL)"""
)
def q_candidate_eligibility(t):
    gone = t("lineitem").where("l_returnflag = 'A' and l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    notes = F.when(F.col("p_brand") == "Brand#3", F.array(F.lit("visibleForTesting")))
    return diff.unused(t("part").where(R.eligible(F.col("p_name"), notes)).select("p_partkey"), gone, key="p_partkey")
