"""Queries over tables with versions, streams of changes, and what is chosen from or looked up in whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import generate as G
from corpusloom.operators import lifecycle as L
from corpusloom.operators import report as P
from corpusloom.operators.phrases import phrases_of_table
from corpusloom.plans import sql as S
from corpusloom.plans.commands import read_records
from corpusloom.plans.queries import LONG, read, register, translated_records
from corpusloom.session import scratch
from corpusloom.sources import records as R
from corpusloom.sources.snapshots import SnapshotTable, upsert
from corpusloom.sources.unknown import UNKNOWN
from corpusloom.sources.workbooks import read_workbooks, write_workbooks
from corpusloom.streaming.changes import merged, merge_stream
from corpusloom.streaming.translate import EchoTranslator, translate_resumably

# --- keys that the schema doesn't know ------------------------------------------------------------------


def unknown_keys_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose users have put the properties of clicks into them, at the top and in two known structs, prepared
    for translation, stored and read again."""
    clicks = read(spark, sf_dir, "clicks").where("click_id is not null")
    clicks = clicks.where(F.try_parse_json("props").isNotNull() & F.startswith(F.trim("props"), F.lit("{")))
    # lines are many times as long as clicks, and a compressed file is read by one task: many files keep all cores busy
    clicks = clicks.select("click_id", "props").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = F.format_string('{"prompt_id":"%d","props":%s,"tier":"T1","instruction_en":{"canonical":"turn left","shown":%s},"metadata":{"split":"dev","seen":%s}}', "click_id", "props", "props", "props")
    raw, ready = (SnapshotTable(spark, f"{scratch(spark, 'unknown')}/{n}", "text") for n in ("raw", "ready"))
    raw.replace(clicks.select(line.alias("value")))
    ready.replace(R.lines_of(L.make_ready(read_records(spark, raw.path, ready=False))))
    again = read_records(spark, ready.path)
    line = R.lines_of(again.withColumn("kept", F.size(UNKNOWN)))
    at = lambda path: F.get_json_object("value", path)
    return line.select(
        at("$.prompt_id").cast("long").alias("click_id"), at("$.props.k").alias("k"), at("$.metadata.seen.device.os").alias("os"), at("$.instruction_en.shown.tags[0]").alias("tag"),
        at("$.metadata.split").alias("split"), at("$.pipeline.stage").alias("stage"), at("$.kept").cast("int").alias("kept"),
    )


register(
    "unknown_keys_kept",
    unknown_keys_kept,
    """SELECT click_id, props->>'$.k' AS k, props->>'$.device.os' AS os, props->>'$.tags[0]' AS tag, 'dev' AS split, 'translation_ready' AS stage, 3 AS kept
    FROM (SELECT click_id, CASE WHEN json_valid(props) THEN props::JSON END AS props FROM clicks WHERE click_id IS NOT NULL) WHERE props IS NOT NULL AND json_type(props) = 'OBJECT'""",
)

# --- versions ---------------------------------------------------------------------------------------------

MONTHS = 5


def sales_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of sales that gets a month a commit, each commit twice, as by a writer that didn't hear of its success,
    and loses sales on hold by a commit of its own: what a reader of each version sees."""
    sales = read(spark, sf_dir, "sales").withColumn("month", F.coalesce(F.month("sold_at"), F.lit(1)))
    table = SnapshotTable(spark, f"{scratch(spark, 'sales')}/sales")
    for month in range(1, MONTHS + 1):
        for _ in range(2):
            table.append(sales.where(F.col("month") == month), run=("months", month))
    upsert(table, lambda now: now.where("coalesce(status, '') <> 'held'"))
    seen = None
    for number in range(MONTHS + 1):
        cents = F.sum(F.round(F.col("total") * 100).cast("long"))
        one = table.read(number).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.count_if(F.col("status") == "done"), F.lit(0)).alias("done"), F.coalesce(cents, F.lit(0)).alias("cents")).withColumn("version", F.lit(number))
        seen = one if seen is None else seen.unionAll(one)
    return seen.join(table.history().select(F.col("number").cast("int").alias("version"), "operation", "parts"), "version")


register(
    "sales_versions",
    sales_versions,
    f"""WITH s AS (SELECT *, coalesce(month(sold_at), 1) AS m FROM sales), v AS (SELECT unnest(range({MONTHS + 1})) AS v)
    SELECT v::INTEGER AS version, count(sale) AS n, count(sale) FILTER (status = 'done') AS done, coalesce(sum(round(total * 100)::BIGINT), 0)::BIGINT AS cents, CASE WHEN v < {MONTHS} THEN 'append' ELSE 'replace' END AS operation, CASE WHEN v < {MONTHS} THEN v + 1 ELSE 1 END::INTEGER AS parts
    FROM v LEFT JOIN (SELECT m, status, total, 1 AS sale FROM s) ON (v < {MONTHS} AND m <= v + 1) OR (v = {MONTHS} AND m <= {MONTHS} AND coalesce(status, '') <> 'held') GROUP BY v""",
)

COMMITS = 4


def summary_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts after each commit of a translation run, as the table of translations has noted them: from the
    counts before the run by what each commit has changed."""
    records = translated_records(spark, sf_dir)
    counts = P.tally(records)
    pending = sum(n for key, n in counts.items() if not key[-1])
    path = f"{scratch(spark, 'run')}/translations"
    translate_resumably(records, path, EchoTranslator, counts=counts, batches_a_commit=max(1, -(-(-(-pending // 32)) // COMMITS)))
    entry = F.explode(F.from_json(F.get_json_object("notes", "$.counts"), "array<array<string>>")).alias("c")
    entries = SnapshotTable(spark, path).history().select(F.col("number").alias("commit"), entry)
    return entries.groupBy("commit", F.col("c")[1].alias("code"), F.col("c")[2].alias("status")).agg(F.sum(F.col("c")[6].cast("long")).alias("n"))


register(
    "summary_by_commit",
    summary_by_commit,
    f"""WITH {LONG}, open AS (SELECT code, status, (row_number() OVER (ORDER BY prompt_id || '|' || code) - 1) // 32 AS batch FROM jobs WHERE NOT complete),
    size AS (SELECT greatest(1, ((count(*) + 31) // 32 + {COMMITS - 1}) // {COMMITS}) AS size FROM open),
    moved AS (SELECT batch // size AS commit, code, coalesce(status, 'missing') AS status FROM open, size),
    commits AS (SELECT DISTINCT commit FROM moved),
    before AS (SELECT code, coalesce(status, 'missing') AS status, count(*) AS n FROM long GROUP BY ALL),
    steps AS (SELECT c.commit, code, status, n FROM commits c, before UNION ALL SELECT c.commit, code, status, -1 FROM commits c JOIN moved m ON m.commit <= c.commit UNION ALL SELECT c.commit, code, 'model_translated', 1 FROM commits c JOIN moved m ON m.commit <= c.commit)
    SELECT commit, code, status, sum(n)::BIGINT AS n FROM steps GROUP BY ALL HAVING sum(n) <> 0""",
)

# --- streams of changes -----------------------------------------------------------------------------------

ORDER = ("seq", "valid_at", "change_id")


def client_changes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clients that a stream of changes leaves: of each the last change, unless that deletes it."""
    changes = read(spark, sf_dir, "client_changes")
    top = scratch(spark, "changes")
    changes.repartition(4).write.parquet(f"{top}/in")
    table = merge_stream(spark, f"{top}/in", changes.schema, ("client_id",), ORDER, f"{top}/clients", f"{top}/check")
    return merged(table, ("client_id",)).where("coalesce(op, '') <> 'D'").select("client_id", "seq", "change_id", "op", "segment", "city", "balance")


register(
    "client_changes_merged",
    client_changes_merged,
    """SELECT client_id, seq, change_id, op, segment, city, balance FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, valid_at DESC NULLS LAST, change_id DESC NULLS LAST) AS n FROM client_changes)
    WHERE n = 1 AND coalesce(op, '') <> 'D'""",
)

# --- selection and look-up ----------------------------------------------------------------------------------

register(
    "review_sample_of_documents",
    lambda spark, d: G.first_of_each(read(spark, d, "documents").select("doc_id", "lang"), by="lang", text="doc_id", wanted=F.call_function("div", F.col("size") * 12 + 99, F.lit(100))).select("lang", "rank", "doc_id"),
    f"""SELECT lang, rank, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('{G.SEED}|' || coalesce(lang, '') || '|' || coalesce(doc_id::VARCHAR, '')), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    WHERE rank <= (n * 12 + 99) // 100""",
)

#: First word and number of words of the phrases taken from each benchmark item.
CUTS = ((1, 1), (2, 2), (4, 3), (7, 4), (11, 1))


def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the phrases taken from the benchmark's items each document holds."""
    words = F.split(X.normalize_for_match("text"), " ")
    cut = F.explode(F.array(*(F.array_join(F.slice(words, i, n), " ") for i, n in CUTS))).alias("phrase")
    phrases = read(spark, sf_dir, "benchmark").select(cut)
    texts = read(spark, sf_dir, "documents").select("doc_id", X.normalize_for_match("text").alias("text"))
    return phrases_of_table(texts, phrases).select("doc_id", F.size("phrases").alias("n"), F.array_join("phrases", "|").alias("phrases"))


_WORDS = f"string_split({S.normalize_for_match('text')}, ' ')"
register(
    "benchmark_phrases",
    benchmark_phrases,
    f"""WITH w AS (SELECT {_WORDS} AS w FROM benchmark), p AS (SELECT DISTINCT phrase FROM (SELECT unnest([{", ".join(f"array_to_string(w[{i}:{i + n - 1}], ' ')" for i, n in CUTS)}]) AS phrase FROM w) WHERE trim(phrase) <> ''),
    d AS (SELECT doc_id, {S.normalize_for_match('text')} AS t FROM documents)
    SELECT doc_id, count(*)::INTEGER AS n, string_agg(phrase, '|' ORDER BY phrase) AS phrases FROM (SELECT DISTINCT doc_id, phrase FROM d JOIN p ON contains(t, phrase)) GROUP BY doc_id""",
)


# --- workbooks ----------------------------------------------------------------------------------------------


def items_as_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items written as a folder of workbooks by the tasks that have them, and read from it."""
    items = read(spark, sf_dir, "items").select("item_id", "name", "brand", "kind", (F.col("price") > 100).alias("dear"))
    path = f"{scratch(spark, 'books')}/items"
    write_workbooks(items, path, ("item_id",))
    cell = lambda name: F.nullif(F.col("cells")[name], F.lit(""))
    return read_workbooks(spark, path).select(cell("item_id").cast("long").alias("item_id"), cell("name").alias("name"), cell("brand").alias("brand"), cell("kind").alias("kind"), (cell("dear") == "1").alias("dear"))


register("items_as_workbooks", items_as_workbooks, "SELECT item_id, nullif(name, '') AS name, nullif(brand, '') AS brand, nullif(kind, '') AS kind, price > 100 AS dear FROM items")
