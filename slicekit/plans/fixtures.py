"""Evaluation-shaped views over the driver's tables.

Each view exists twice: as a Spark DataFrame (``items(spark, sf_dir)``) and as
a DuckDB/ANSI SQL common table expression (``SQL["items"]``) used by the
oracle.  The views follow the definitions in FIXTURES.md section B.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURE, EvalConfig

# Fixed values of the fixture views (FIXTURES.md B)
FIX_MODELS = ((0, "m0", 950, 550), (1, "m1", 930, 480), (2, "m2", 900, 350), (3, "m3", 800, 120))
FIX_CONDITIONS = ((0, "openbook"), (1, "closedbook"))
FIX_RULES = (("newline", "\n"), ("pipe", " | "), ("email", "@"))
LONG_CHARS = 1500
MT_LONG_CHARS = 220


_PLANS: dict = {}


def memo_plan(fn):
    """Reuse the (immutable, lazy) DataFrame a view builder returns for the
    same session and table folder: building a plan costs thousands of
    driver <-> JVM calls, and many queries share the same views.  Only plan
    objects are kept; a builder that writes tables must not be memoised."""
    def wrapped(spark, sf_dir, *args):
        if args and any(a is not None for a in args):
            return fn(spark, sf_dir, *args)
        key = (fn.__module__, fn.__qualname__, id(spark), sf_dir.rstrip("/"))
        hit = _PLANS.get(key)
        if hit is None or hit[0] is not spark:
            hit = (spark, fn(spark, sf_dir))
            _PLANS[key] = hit
        return hit[1]
    wrapped.__name__, wrapped.__doc__, wrapped.__qualname__ = fn.__name__, fn.__doc__, fn.__qualname__
    return wrapped


def forget_plans() -> None:
    """Build all view plans anew from here on."""
    _PLANS.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def second_word(text: str = "text"):
    """The answer of an item: the second word of its text, '' if there is none."""
    return F.split_part(F.col(text), F.lit(" "), F.lit(2))


def _phenomena(text: str = "text", n_chars=None):
    """Tag list of a text from the four fixture phenomena (array, in vocab order)."""
    t = F.col(text)
    long_ = (F.col(n_chars) if n_chars else F.length(t)) > LONG_CHARS
    arr = F.array(F.when(t.contains("\n"), F.lit("newline")),
                  F.when(t.contains(" | "), F.lit("pipe")),
                  F.when(t.contains("@"), F.lit("email")),
                  F.when(long_, F.lit("long")))
    return F.filter(arr, lambda x: x.isNotNull())


@memo_plan
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA items: one per document; tagged iff the document has a label row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id").withColumn("_lab", F.lit(True))
    return _items_of(d.join(lab, "doc_id", "left"))


@memo_plan
def plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items without their tags (null here): no join with ``labels``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return _items_of(d.withColumn("_lab", F.lit(None).cast("boolean")))


@memo_plan
def plain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells without their items' tags (null here): no join with ``labels``."""
    return cells(spark, sf_dir, plain_items(spark, sf_dir))


def _items_of(j: DataFrame) -> DataFrame:
    tagged = F.col("_lab").isNotNull()
    para = (F.when(F.col("doc_id") % 10 < 4, "literal_match")
             .when(F.col("doc_id") % 10 < 9, "paraphrase").otherwise("requires_inference"))
    dom = (F.when(F.col("doc_id") % 7 < 2, "local_history")
            .when(F.col("doc_id") % 7 == 2, "local_geography").otherwise("general"))
    tags = F.struct(_phenomena("text", "n_chars").alias("linguistic_phenomena"),
                    para.alias("paraphrase_distance"), dom.alias("domain"))
    return j.select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        "lang",
        F.concat(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.lit("_native"))
                 .otherwise(F.lit("_translated"))).alias("dataset"),
        F.substring_index("text", "\n", 1).alias("question"),
        F.col("text").alias("context"),
        second_word().alias("gold"),
        F.when(tagged, tags).alias("tags"),
    )


def _model_cond_array():
    return F.array(*[F.struct(F.lit(mi).alias("mi"), F.lit(m).alias("model"), F.lit(po).alias("p_open"),
                              F.lit(pc).alias("p_closed"), F.lit(ci).alias("ci"), F.lit(c).alias("condition"))
                     for mi, m, po, pc in FIX_MODELS for ci, c in FIX_CONDITIONS])


@memo_plan
def cells(spark: SparkSession, sf_dir: str, it: DataFrame | None = None) -> DataFrame:
    """Long (item, model, condition) results; 5 % absent, ~3 % unjudged.

    The model x condition grid is a literal array exploded per item, so no
    join or cartesian product is planned.  Cells are stored denormalised
    (``lang, dataset, tags`` of the item on every cell), so slicing them
    needs no join back to the items.
    """
    it = it if it is not None else items(spark, sf_dir)
    x = it.select("doc_id", "id", "lang", "dataset", "tags", F.explode(_model_cond_array()).alias("mc"))
    h = (F.col("doc_id") * 7919 + F.col("mc.mi") * 104729 + F.col("mc.ci") * 1299709) % 1000
    h2 = F.col("doc_id") * 31 + F.col("mc.mi") * 17 + F.col("mc.ci") * 5
    p = F.when(F.col("mc.ci") == 0, F.col("mc.p_open")).otherwise(F.col("mc.p_closed"))
    x = x.select("id", "lang", "dataset", "tags", F.col("mc.model").alias("model"),
                 F.col("mc.condition").alias("condition"), h.alias("h"), h2.alias("h2"), p.alias("p"))
    x = x.filter(F.col("h2") % 20 != 0)
    correct = F.when(F.col("h2") % 33 == 0, F.lit(None).cast("boolean")).otherwise(F.col("h") < F.col("p"))
    return x.select(
        "id", "lang", "dataset", "model", "condition",
        F.concat(F.lit("ans_"), F.col("h").cast("string")).alias("prediction"),
        F.when(correct, F.lit("correct")).when(~correct, F.lit("incorrect")).alias("verdict"),
        F.when(correct.isNotNull(), F.lit("")).alias("reason"),
        correct.alias("correct"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        "tags",
    )


def _mt_phenomena():
    """The same four names by signs that occur in the short benchmark texts on
    either side: a line end, a comma, a vowel letter beyond ASCII, over 220 characters."""
    t = F.col("text")
    arr = F.array(F.when(t.contains("\n"), F.lit("newline")), F.when(t.contains(","), F.lit("pipe")),
                  F.when(t.rlike("[áéíóúèêàâîôûäöü]"), F.lit("email")), F.when(F.length(t) > MT_LONG_CHARS, F.lit("long")))
    return F.filter(arr, lambda x: x.isNotNull()).alias("linguistic_phenomena")


@memo_plan
def mt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    lang = F.when(F.col("item_id") % 3 == 0, "de").when(F.col("item_id") % 3 == 1, "en").otherwise("fr")
    return b.select(F.col("item_id"), F.concat(F.lit("b_"), F.col("item_id").cast("string")).alias("id"),
                    lang.alias("lang"), F.col("text").alias("ref"),
                    F.struct(_mt_phenomena()).alias("tags"))


@memo_plan
def translations(spark: SparkSession, sf_dir: str, mi: DataFrame | None = None) -> DataFrame:
    """(id, model, hyp): four synthetic systems of falling quality."""
    mi = mi if mi is not None else mt_items(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(i).alias("mi"), F.lit(m).alias("model")) for i, m, _, _ in FIX_MODELS])
    x = mi.select("item_id", "id", "lang", "ref", F.explode(models).alias("m"))
    hyp = (F.when(F.col("m.mi") == 0, F.col("ref"))
            .when(F.col("m.mi") == 1, F.regexp_replace("ref", "[aou]", ""))
            .when(F.col("m.mi") == 2, F.replace(F.col("ref"), F.lit("e"), F.lit("a")))
            .otherwise(F.lower(F.regexp_replace("ref", "(th|en|er|la)", "ba"))))
    return x.select("item_id", "id", "lang", F.col("m.model").alias("model"),
                    F.col("m.mi").alias("mi"), hyp.alias("hyp"))


@memo_plan
def mt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mi = mt_items(spark, sf_dir)
    tr = translations(spark, sf_dir)
    return tr.join(mi.select("id", "ref", "tags"), "id")


@memo_plan
def parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return (c.filter(F.col("role").isin("user", "assistant"))
             .select(F.concat_ws("_", "conv_id", F.col("turn") - F.col("turn") % 2).alias("pair_id"),
                     "conv_id", "turn", "role", "text"))


@memo_plan
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    reply = (F.when(k == 0, F.col("props"))
              .when(k == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
              .when(k == 2, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")))
              .when(k == 3, F.lit("no json here"))
              .otherwise(F.lit("{broken}")))
    return e.select("event_id", "event_type", "value", reply.alias("reply"))


@memo_plan
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge-style replies: JSON verdict objects in the same five wrappings."""
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("value") >= 50, F.lit("correct")).otherwise(F.lit("incorrect"))
    obj = F.concat(F.lit('{"verdict": "'), verdict, F.lit('", "reason": "'), F.col("event_type"), F.lit('"}'))
    k = F.col("event_id") % 5
    reply = (F.when(k == 0, obj)
              .when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
              .when(k == 2, F.concat(F.lit("Sure: "), obj, F.lit(" done")))
              .when(k == 3, F.lit("no json here"))
              .otherwise(F.lit("{broken}")))
    return e.select("event_id", F.concat(F.lit("doc_"), F.col("event_id").cast("string")).alias("id"),
                    reply.alias("reply"))


# ---------------------------------------------------------------------------
# The same views in SQL (DuckDB dialect, also valid Spark SQL where noted)
# ---------------------------------------------------------------------------
_PH_SQL = """
 contains({t}, chr(10)) AS t_newline, contains({t}, ' | ') AS t_pipe,
 contains({t}, '@') AS t_email, {len} > 1500 AS t_long"""

SQL: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}

SQL["items"] = """
SELECT d.doc_id, 'doc_' || CAST(d.doc_id AS VARCHAR) AS id, d.lang,
 d.lang || CASE WHEN d.doc_id % 2 = 0 THEN '_native' ELSE '_translated' END AS dataset,
 split_part(d.text, chr(10), 1) AS question, d.text AS context, split_part(d.text, ' ', 2) AS gold,
 l.doc_id IS NOT NULL AS tagged,
 l.doc_id IS NOT NULL AND contains(d.text, chr(10)) AS t_newline,
 l.doc_id IS NOT NULL AND contains(d.text, ' | ')   AS t_pipe,
 l.doc_id IS NOT NULL AND contains(d.text, '@')     AS t_email,
 l.doc_id IS NOT NULL AND d.n_chars > 1500          AS t_long,
 CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 10 < 4 THEN 'literal_match'
      WHEN d.doc_id % 10 < 9 THEN 'paraphrase' ELSE 'requires_inference' END AS paraphrase_distance,
 CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 7 < 2 THEN 'local_history'
      WHEN d.doc_id % 7 = 2 THEN 'local_geography' ELSE 'general' END AS domain
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

SQL["models"] = "SELECT * FROM (VALUES (0,'m0',950,550),(1,'m1',930,480),(2,'m2',900,350),(3,'m3',800,120)) AS t(mi, model, p_open, p_closed)"
SQL["conditions"] = "SELECT * FROM (VALUES (0,'openbook'),(1,'closedbook')) AS t(ci, condition)"

SQL["cells"] = """
SELECT id, lang, dataset, model, condition, 'ans_' || CAST(h AS VARCHAR) AS prediction,
 CASE WHEN h2 % 33 = 0 THEN NULL WHEN h < p THEN 1 ELSE 0 END AS correct
FROM (SELECT i.id, i.lang, i.dataset, m.model, c.condition,
        (i.doc_id * 7919 + m.mi * 104729 + c.ci * 1299709) % 1000 AS h,
        (i.doc_id * 31 + m.mi * 17 + c.ci * 5) AS h2,
        CASE WHEN c.ci = 0 THEN m.p_open ELSE m.p_closed END AS p
      FROM items i CROSS JOIN models m CROSS JOIN conditions c) x
WHERE h2 % 20 <> 0"""
DEPS["cells"] = ("items", "models", "conditions")

# QA rows with a judgement joined to their item tags (R1 over all languages)
SQL["scored"] = """
SELECT c.id, c.lang, c.dataset, c.model, c.condition, c.correct,
 i.tagged, i.t_newline, i.t_pipe, i.t_email, i.t_long, i.paraphrase_distance, i.domain
FROM cells c JOIN items i ON c.id = i.id
WHERE c.correct IS NOT NULL"""
DEPS["scored"] = ("cells", "items")

SQL["mt_items"] = """
SELECT item_id, 'b_' || CAST(item_id AS VARCHAR) AS id,
 CASE item_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'fr' END AS lang, text AS ref,
 contains(text, chr(10)) AS t_newline, contains(text, ',') AS t_pipe,
 regexp_matches(text, '[áéíóúèêàâîôûäöü]') AS t_email, length(text) > 220 AS t_long
FROM benchmark"""

SQL["mt_pairs"] = """
SELECT b.item_id, b.id, b.lang, m.mi, m.model, b.ref,
 CASE m.mi WHEN 0 THEN b.ref WHEN 1 THEN regexp_replace(b.ref, '[aou]', '', 'g')
           WHEN 2 THEN replace(b.ref, 'e', 'a') ELSE lower(regexp_replace(b.ref, '(th|en|er|la)', 'ba', 'g')) END AS hyp,
 b.t_newline, b.t_pipe, b.t_email, b.t_long
FROM mt_items b CROSS JOIN models m"""
DEPS["mt_pairs"] = ("mt_items", "models")

SQL["parallel"] = """
SELECT conv_id || '_' || (turn - turn % 2) AS pair_id, conv_id, turn, role, text
FROM conversations WHERE role IN ('user','assistant')"""

SQL["replies"] = """
SELECT event_id, event_type, value, CASE event_id % 5 WHEN 0 THEN props
  WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 2 THEN 'Sure: ' || props || ' done' WHEN 3 THEN 'no json here'
  ELSE '{broken' || '}' END AS reply
FROM events"""

SQL["judge_replies"] = """
SELECT event_id, 'doc_' || CAST(event_id AS VARCHAR) AS id,
 CASE event_id % 5 WHEN 0 THEN obj
  WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```'
  WHEN 2 THEN 'Sure: ' || obj || ' done' WHEN 3 THEN 'no json here'
  ELSE '{broken' || '}' END AS reply
FROM (SELECT event_id, '{"verdict": "' || CASE WHEN value >= 50 THEN 'correct' ELSE 'incorrect' END
             || '", "reason": "' || event_type || '"}' AS obj FROM events) e"""


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, ()):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"


def register_sql(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    SQL[name] = sql
    DEPS[name] = deps


CONFIG: EvalConfig = FIXTURE

# Vocabulary spelled for the oracle SQL
PH = ("newline", "pipe", "email", "long")
PARA = ("literal_match", "paraphrase", "requires_inference")
DOM = ("local_history", "local_geography", "general")
LANGS_SQL = "('de','en','es','fr')"


def sql_values(col: str, vals) -> str:
    """A one-column VALUES table."""
    return "(SELECT * FROM (VALUES " + ",".join(f"('{v}')" for v in vals) + f") AS t({col}))"


def sql_has(ph: str = "phenomenon") -> str:
    """The boolean of phenomenon column ``ph`` from the t_* flags."""
    return "CASE " + ph + " " + " ".join(f"WHEN '{p}' THEN t_{p}" for p in PH) + " END"
