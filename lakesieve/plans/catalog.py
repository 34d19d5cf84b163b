"""Queries over the driver's tables and the same in SQL.

benchmark is the manifest of secret items; documents, pages and conversations are stores; events are trials (task = user,
arm = event type, score = value) and, in the order of time and id, a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.functions import text as T
from lakesieve.operators import grade, holdout, ledger, scan, seal, surfaces

CONFIG = grade.GradeConfig()


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    b = _table(spark, d, "benchmark")
    return scan.manifest(b.select(F.col("item_id").alias("instance"), F.concat(F.lit("item:"), "item_id").alias("seed"), "text"), unicode_fold=False)


def _store(spark: SparkSession, d: str, name: str) -> DataFrame:
    t = _table(spark, d, name)
    if name == "documents":
        return t.select(F.col("doc_id").alias("store_file"), "text")
    if name == "pages":
        return t.select(F.col("page_id").alias("store_file"), F.col("html").alias("text"))
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("store_file"), "text")


def _found(spark: SparkSession, d: str, name: str = "documents", items: DataFrame | None = None) -> DataFrame:
    return scan.findings(_store(spark, d, name), _items(spark, d) if items is None else items, unicode_fold=False)


def q01(spark, d):
    w = F.size(T.words("normalized"))
    return _items(spark, d).select("instance", "full_sha256", w.alias("n_words"), F.size("shingles").alias("n_shingles"))


def q02(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", T.words(T.normalized("text", False)).alias("w"))
    return docs.select("doc_id", F.posexplode(T.windows("w")).alias("pos", "x")).select("doc_id", "pos", T.sha("x").alias("h"))


def q03(spark, d):
    f = _found(spark, d).where("severity = 'exact' or matched_shingles >= 2")
    return f.select("store_file", "instance", "matched_shingles", "total_shingles", "evidence_shingle")


def q04(spark, d):
    return _found(spark, d).where("severity = 'exact'").select("store_file", "instance", F.col("first_word_pos").alias("char_pos"))


def q05(spark, d):
    return _found(spark, d)


def q06(spark, d):
    return _found(spark, d, "pages")


def q07(spark, d):
    return _found(spark, d, "conversations")


def q08(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("store_file"), "lang", "source")
    return _found(spark, d).join(docs, "store_file").groupBy("severity", "lang", "source").agg(F.count("*").alias("n"))


def q09(spark, d):
    labels = _table(spark, d, "labels").withColumnRenamed("doc_id", "store_file")
    return _found(spark, d).join(labels, "store_file").groupBy("severity", "quality", "toxic").agg(F.count("*").alias("n"))


def q10(spark, d):
    s = _store(spark, d, "documents").withColumn("n_bytes", F.octet_length("text"))
    return scan.skipped(scan.gated(s, 2000))


def q11(spark, d):
    items = _items(spark, d).withColumn("retired", F.col("instance") % 2 == 1)
    return _found(spark, d, items=items)


def q12(spark, d):
    return _table(spark, d, "documents").select("doc_id").join(_found(spark, d).select(F.col("store_file").alias("doc_id")), "doc_id", "left_anti")


def _log(spark, d):
    return _table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "event_id", "event_type", "value")


def q13(spark, d):
    return ledger.latest(_log(spark, d), "user_id").select("user_id", "event_id", "event_type", "value")


def q14(spark, d):
    counts = _log(spark, d).groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return counts.join(q13(spark, d).select("user_id", F.col("event_type").alias("state")), "user_id")


def _trials(spark, d):
    e = _table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("task"), F.col("event_type").alias("arm"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", "environment drift").alias("reason"))


def _signs(spark, d):
    return grade.pairs(_trials(spark, d).where("reason is null"), "click", "view")


def q15(spark, d):
    return grade.per_task(_signs(spark, d), _trials(spark, d))


def q16(spark, d):
    shares = _trials(spark, d).agg((100.0 * F.count_if(F.col("reason").isNotNull()) / F.greatest(F.lit(1), F.count("*"))).alias("excluded_pct"))
    return _signs(spark, d).agg(F.count("*").alias("n_pairs"), F.bround(F.avg("sign"), 6).alias("net")).crossJoin(shares.select(F.bround("excluded_pct", 4).alias("excluded_pct")))


def q17(spark, d):
    return grade.hash_interval(_signs(spark, d), ["task"], CONFIG.bootstrap_b, CONFIG.seed).select("task", F.bround("lo", 6).alias("lo"), F.bround("hi", 6).alias("hi"))


def q18(spark, d):
    return grade.verdict(_trials(spark, d), "click", "view", _trials(spark, d), CONFIG)


def q18_interval(spark, d):
    return grade.interval(_signs(spark, d), CONFIG)


def q19(spark, d):
    return grade.per_task(_signs(spark, d), _trials(spark, d)).where("mean_sign is null or mean_sign <= 0").select("task", "n_pairs")


def _snapshots(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("path"), T.sha("text").alias("sha"))
    now = docs.where("path % 7 != 0").withColumn("sha", F.when(F.col("path") % 5 == 0, T.sha(F.concat("sha", F.lit("x")))).otherwise(F.col("sha")))
    return docs.where("path % 11 != 0"), now


def q20(spark, d):
    return seal.differences(*_snapshots(spark, d))


PACKAGES = (["numpy==1.0", "pandas==2.0", "regex==3.1"], ["numpy==1.1", "pandas==2.0", "duckdb==2.0"])


def q21(spark, d):
    a, b = (spark.createDataFrame([tuple(p.split("==")) for p in ps], "name string, version string") for ps in PACKAGES)
    return seal.package_diff(a, b)


def q22(spark, d):
    e = _table(spark, d, "events")
    payload = F.concat_ws("|", "event_id", "user_id", "event_type")
    log = ledger.chained(e.select("user_id", "event_id", F.struct("ts", "event_id").alias("seq"), "event_type"), payload, ["user_id"])
    tampered = log.withColumn("line", F.when(F.col("event_id") % 97 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return ledger.chain_breaks(tampered, ["user_id"]).select("user_id", "event_id", "prev", "expected")


def q23(spark, d):
    b = _table(spark, d, "benchmark").select(F.col("item_id").alias("i"))
    m = b.where("i % 5 != 0").select(F.col("i").alias("instance"), F.concat(F.lit("fam:"), "i").alias("seed"), (F.col("i") % 3 == 0).alias("retired"))
    made = b.where("i % 4 != 0").select(F.col("i").alias("instance"), F.lit("generated").alias("kind"))
    ended = b.where("i % 6 = 0").select(F.col("i").alias("instance"), F.lit("retired").alias("kind"))
    return ledger.divergence(m, made.unionByName(ended), "fam")


FAMILIES = [
    ("frost", "task {{ tag }}: {{ nums }} to {{nums}}", [("nums", "int_list", 1, 15, 4, None, None), ("tag", "permutation", None, None, None, ['"A"', '"B"', '"C"', '"D"'], None)]),
    ("gate", "pick {{ one }} of {{ n }}", [("one", "choice", None, None, None, ['"x"', '"y"', '"z"'], None), ("n", "int", 3, 9, None, None, None)]),
]


def _families(spark):
    return spark.createDataFrame(FAMILIES, f"family string, prompt string, slots {holdout.SLOTS}")


def q24(spark, d):
    return holdout.cardinality(_families(spark)).select("family", F.col("cardinality").cast("long").alias("cardinality"))


def q25(spark, d):
    used = _table(spark, d, "orders").select(F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 7).alias("n"))
    return ledger.next_counter(used)


def q26(spark, d):
    return scan.overlapping_items(_items(spark, d))


def q27(spark, d):
    tasks, arms = _table(spark, d, "customer").select(F.col("c_custkey").alias("task")), _table(spark, d, "events").select(F.col("event_type").alias("arm")).distinct()
    return grade.trial_matrix(tasks, arms, 2, CONFIG.seed)


PATHS = [
    ("/h/MEMORY.md", False), ("/h/app.sqlite", False), ("/h/memory.sqlite", False), ("/h/proj", True), ("/h/proj/logs", True), ("/h/proj/logs/run.log", False),
    ("/h/proj/outputs", True), ("/h/.git", True), ("/h/.claude", True), ("/h/.chroma", True), ("/h/x.faiss", False), ("/h/notes.txt", False),
]


def q28(spark, d):
    e = spark.createDataFrame([(p, x, 10) for p, x in PATHS], "path string, is_dir boolean, size long").withColumn("modified", F.lit(None).cast("timestamp"))
    return surfaces.classified(e)


def q29(spark, d):
    bad = _trials(spark, d).where("reason is not null").select("seq", "task", "arm", F.concat("reason", F.lit(" "), "task").alias("reason"))
    return grade.public_face(bad)


def q30(spark, d):
    return holdout.derived(spark.range(100).select(F.explode(F.array(F.lit("frost"), F.lit("gate"))).alias("family"), F.col("id").alias("n")), _families(spark))


def q31(spark, d):
    c = _table(spark, d, "conversations")
    equal = grade.verified(F.col("text"), F.when(F.col("turn") == 0, F.concat(F.lit(" "), "text", F.lit("\n"))), F.lit("(?:the|die|les?) [a-z]+"))
    return c.select("conv_id", "turn", equal.alias("score"))


def q32(spark, d):
    c = _table(spark, d, "conversations")
    return scan.add_instances(c.select(F.col("conv_id").alias("instance"), F.concat(F.lit("conv:"), "conv_id").alias("seed"), F.col("turn").alias("position"), "text"), unicode_fold=False).select("instance", "full_sha256")


QUERIES = {
    "q01_manifest": q01, "q02_shingles": q02, "q03_overlap": q03, "q04_exact": q04, "q05_findings_documents": q05, "q06_findings_pages": q06, "q07_findings_conversations": q07,
    "q08_by_severity": q08, "q09_by_label": q09, "q10_skipped": q10, "q11_retired": q11, "q12_clean": q12, "q13_latest": q13, "q14_states": q14, "q15_signs": q15, "q16_net": q16,
    "q17_hash_interval": q17, "q18_verdict": q18, "q18_interval": q18_interval, "q19_every_task": q19, "q20_seal": q20, "q21_packages": q21, "q22_chain": q22, "q23_divergence": q23,
    "q24_cardinality": q24, "q25_next_counter": q25, "q26_item_overlap": q26, "q27_trial_matrix": q27, "q28_surfaces": q28, "q29_public": q29, "q30_slots": q30, "q31_verifier": q31, "q32_instances": q32,
}


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _shingled(key: str, source: str) -> str:
    return f"""
  SELECT {key}, pos, substr(sha256(array_to_string(w[pos + 1 : pos + 8], ' ')), 1, 16) AS h
  FROM (SELECT {key}, w, unnest(range(greatest(len(w) - 7, 0))) AS pos FROM (SELECT {key}, string_split(norm, ' ') AS w FROM {source}))"""


def _find(store: str, active: str = "true") -> str:
    """CTEs up to `found`, the findings of a store given as SELECT store_file, text."""
    return f"""
WITH s AS (SELECT store_file, {_norm("text")} AS norm FROM ({store})),
i AS (SELECT item_id AS instance, {_norm("text")} AS norm, sha256(coalesce(text, '')) AS full_sha256 FROM benchmark WHERE {active}),
ih AS (SELECT instance, h, min(pos) AS p FROM ({_shingled("instance", "i")}) GROUP BY instance, h),
it AS (SELECT instance, count(*) AS total, min(h) AS least FROM ih GROUP BY instance),
sh AS ({_shingled("store_file", "s")}),
hit AS (SELECT store_file, instance, count(DISTINCT h) AS m, min(pos) AS fp, min(h) AS ev FROM sh JOIN ih USING (h) GROUP BY store_file, instance),
x AS (
  SELECT hit.*, total, least, full_sha256, contains(s.norm, i.norm) AS exact, instr(s.norm, i.norm) AS place
  FROM hit JOIN i USING (instance) JOIN it USING (instance) JOIN s USING (store_file)),
y AS (SELECT *, CASE WHEN exact THEN total ELSE m END AS matched FROM x WHERE exact OR m >= 2),
found AS (
  SELECT store_file, instance, 'item:' || instance AS seed,
         CASE WHEN exact THEN 'exact' WHEN 100.0 * matched / total >= 5 THEN 'near' ELSE 'trace' END AS severity,
         matched::INT AS matched_shingles, total::INT AS total_shingles, round_even(100.0 * matched / total, 2)::DOUBLE AS overlap_pct,
         (CASE WHEN exact THEN place - 1 ELSE fp END)::INT AS first_word_pos, CASE WHEN exact THEN least ELSE ev END AS evidence_shingle,
         substr(sha256(full_sha256), 1, 16) AS content_ref
  FROM y)
"""


_DOCS = "SELECT doc_id AS store_file, text FROM documents"
_ALL = "SELECT * FROM found"
_TRIALS = "SELECT event_id AS seq, user_id AS task, event_type AS arm, value AS score, CASE WHEN event_type = 'error' THEN 'environment drift' END AS reason FROM events"
_SIGNS = f"""
WITH t AS ({_TRIALS}),
g AS (SELECT a.task, a.seq AS a_seq, b.seq AS b_seq, sign(a.score - b.score)::INT AS sign FROM t a JOIN t b USING (task) WHERE a.arm = 'click' AND b.arm = 'view'),
p AS (SELECT task, count(*) AS n_pairs, round_even(avg(sign), 4) AS mean_sign FROM g GROUP BY task),
pt AS (SELECT task, coalesce(n_pairs, 0) AS n_pairs, mean_sign FROM (SELECT DISTINCT task FROM t) LEFT JOIN p USING (task))
"""

ORACLE = {
    "q01_manifest": f"""WITH i AS (SELECT item_id AS instance, sha256(coalesce(text, '')) AS full_sha256, string_split({_norm("text")}, ' ') AS w FROM benchmark),
h AS (SELECT instance, count(DISTINCT array_to_string(w[pos + 1 : pos + 8], ' ')) AS n FROM (SELECT instance, w, unnest(range(greatest(len(w) - 7, 0))) AS pos FROM i) GROUP BY instance)
SELECT instance, full_sha256, len(w)::INT AS n_words, coalesce(n, 0)::INT AS n_shingles FROM i LEFT JOIN h USING (instance)""",
    "q02_shingles": f"WITH s AS (SELECT doc_id, {_norm('text')} AS norm FROM documents) {_shingled('doc_id', 's')}",
    "q03_overlap": _find(_DOCS) + "SELECT store_file, instance, matched_shingles, total_shingles, evidence_shingle FROM found",
    "q04_exact": _find(_DOCS) + "SELECT store_file, instance, first_word_pos AS char_pos FROM found WHERE severity = 'exact'",
    "q05_findings_documents": _find(_DOCS) + _ALL,
    "q06_findings_pages": _find("SELECT page_id AS store_file, html AS text FROM pages") + _ALL,
    "q07_findings_conversations": _find("SELECT conv_id || ':' || turn AS store_file, text FROM conversations") + _ALL,
    "q08_by_severity": _find(_DOCS) + "SELECT severity, lang, source, count(*) AS n FROM found JOIN documents ON store_file = doc_id GROUP BY ALL",
    "q09_by_label": _find(_DOCS) + "SELECT severity, quality, toxic, count(*) AS n FROM found JOIN labels ON store_file = doc_id GROUP BY ALL",
    "q10_skipped": """SELECT skip_reason, count(*) AS n FROM (
  SELECT CASE WHEN octet_length(encode(text)) > 2000 THEN 'too-large' WHEN contains(left(text, 1024), chr(0)) THEN 'binary' END AS skip_reason FROM documents)
WHERE skip_reason IS NOT NULL GROUP BY skip_reason""",
    "q11_retired": _find(_DOCS, "item_id % 2 <> 1") + _ALL,
    "q12_clean": _find(_DOCS) + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT store_file FROM found)",
    "q13_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q14_states": """WITH l AS (SELECT user_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_type AS kind, count(*) AS n, state FROM events JOIN l USING (user_id) GROUP BY ALL""",
    "q15_signs": _SIGNS + "SELECT task, n_pairs, mean_sign FROM pt",
    "q16_net": _SIGNS + "SELECT (SELECT count(*) FROM g) AS n_pairs, (SELECT round_even(avg(sign), 6) FROM g) AS net, round_even(100.0 * count(reason) / greatest(1, count(*)), 4) AS excluded_pct FROM t",
    "q19_every_task": _SIGNS + "SELECT task, n_pairs FROM pt WHERE mean_sign IS NULL OR mean_sign <= 0",
    "q20_seal": """WITH d AS (SELECT doc_id AS path, substr(sha256(text), 1, 16) AS sha FROM documents),
a AS (SELECT path, sha AS was FROM d WHERE path % 11 <> 0),
b AS (SELECT path, CASE WHEN path % 5 = 0 THEN substr(sha256(sha || 'x'), 1, 16) ELSE sha END AS now FROM d WHERE path % 7 <> 0)
SELECT path, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'added' ELSE 'modified' END AS problem FROM a FULL JOIN b USING (path) WHERE now IS NULL OR was IS NULL OR was <> now""",
    "q21_packages": """WITH a(name, version) AS (VALUES ('numpy', '1.0'), ('pandas', '2.0'), ('regex', '3.1')), b(name, version) AS (VALUES ('numpy', '1.1'), ('pandas', '2.0'), ('duckdb', '2.0'))
SELECT 'pkg+' AS change, name || '==' || version AS package FROM b WHERE (name, version) NOT IN (SELECT (name, version) FROM a)
UNION ALL SELECT 'pkg-', name || '==' || version FROM a WHERE (name, version) NOT IN (SELECT (name, version) FROM b)
UNION ALL SELECT 'pkg~', a.name || ': ' || a.version || ' -> ' || b.version FROM a JOIN b USING (name) WHERE a.version <> b.version""",
    "q22_chain": """WITH l AS (SELECT *, concat_ws('|', event_id, user_id, event_type) AS line FROM events),
c AS (SELECT *, lag(sha256(line || chr(10)), 1, repeat('0', 64)) OVER w AS prev, CASE WHEN event_id % 97 = 0 THEN line || '!' ELSE line END AS bad FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, lag(sha256(bad || chr(10)), 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expected FROM c)
SELECT user_id, event_id, prev, expected FROM x WHERE prev <> expected""",
    "q23_divergence": """WITH b AS (SELECT item_id AS i FROM benchmark), m AS (SELECT i, i % 3 = 0 AS retired FROM b WHERE i % 5 <> 0), g AS (SELECT i FROM b WHERE i % 4 <> 0), r AS (SELECT i FROM b WHERE i % 6 = 0)
SELECT i AS instance, 'in ledger, not in manifest' AS problem FROM g WHERE i NOT IN (SELECT i FROM m)
UNION SELECT i, 'retired in manifest, not in ledger' FROM m WHERE retired AND i NOT IN (SELECT i FROM r)
UNION SELECT i, 'retired in ledger, not in manifest' FROM r WHERE i NOT IN (SELECT i FROM m WHERE retired)""",
    "q24_cardinality": "SELECT * FROM (VALUES ('frost', (pow(15, 4) * factorial(4))::BIGINT), ('gate', 21::BIGINT)) t(family, cardinality)",
    "q25_next_counter": """WITH u AS (SELECT DISTINCT o_custkey AS family, o_orderkey % 7 AS n FROM orders), c AS (SELECT family, unnest(range(8)) AS k FROM (SELECT DISTINCT family FROM u))
SELECT family, min(k)::INT AS next_n FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.family = c.family AND u.n = c.k) GROUP BY family""",
    "q26_item_overlap": f"""WITH i AS (SELECT item_id AS instance, {_norm("text")} AS norm FROM benchmark), h AS (SELECT DISTINCT instance, h FROM ({_shingled("instance", "i")}))
SELECT x.instance AS a, y.instance AS b, count(*) AS n_shared FROM h x JOIN h y USING (h) WHERE x.instance < y.instance GROUP BY ALL HAVING count(*) >= 2""",
    "q27_trial_matrix": f"""SELECT task, arm, repeat::INT AS repeat, row_number() OVER (ORDER BY sha256(concat_ws(':', {CONFIG.seed}, task, arm, repeat)), task, arm, repeat) AS position
FROM (SELECT c_custkey AS task FROM customer), (SELECT DISTINCT event_type AS arm FROM events), range(1, 3) r(repeat)""",
    "q28_surfaces": """SELECT * FROM (VALUES ('/h/MEMORY.md', 'memory-file', 10::BIGINT, '?'), ('/h/memory.sqlite', 'vector-store', 10, '?'), ('/h/proj/logs', 'transcripts', -1, '?'),
('/h/.claude', 'agent-state', -1, '?'), ('/h/.chroma', 'vector-store', -1, '?'), ('/h/x.faiss', 'vector-store', 10, '?')) t(path, kind, size, modified)""",
    "q29_public": f"SELECT seq, task, arm, substr(sha256(reason || ' ' || task), 1, 12) AS reason FROM ({_TRIALS}) WHERE reason IS NOT NULL",
    "q31_verifier": "SELECT conv_id, turn, CASE WHEN turn = 0 OR regexp_matches(text, '(?:the|die|les?) [a-z]+') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM conversations",
    "q32_instances": "SELECT conv_id AS instance, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS full_sha256 FROM conversations GROUP BY conv_id",
}
