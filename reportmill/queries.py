"""The driver's queries over the supplied tables, each with DuckDB SQL that gives the same rows.

The tables have no reports, so file names are derived from documents by one formula in both engines: the type from
doc_id mod 3, a date within 59 days, a target, the source as broker, and the text as title.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as X
from .functions import udtf
from .operators import asof, chunk, listing, prices, registry, retrieve, rollup, session
from .operators.vector_index import VectorIndex
from .plans import sqlguard
from .sources import files, store
from .streaming import conversations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for costly work on rows of a table with fewer splits than that; others stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() < n else df


# ---- catalog ------------------------------------------------------------------------------------------------------


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("company", "industry", "economy"))), (F.col("doc_id") % 3 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7 % 59).cast("int")), "yyyy-MM-dd")
    target = F.when(F.col("doc_id") % 3 == 2, "null").otherwise(F.concat(F.lit("T"), (F.col("doc_id") % 17).cast("string")))
    return d.select("doc_id", registry.build_file_name(kind, day, target, F.col("source"), F.col("text")).alias("file_name"))


def reports(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    return registry.parse_names(names(spark, sf_dir), keep=("doc_id",) if with_id else ())


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents stand for files that are already embedded."""
    return names(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("file_name")


WS = X.SPACE


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def part_sql(x: str) -> str:
    forbidden = '[\\\\/:*?"<>|]'
    inner = f"regexp_replace({x}, '{forbidden}', '', 'g')"
    return f"replace({strip_sql(inner)}, '_', '-')"


NAMES = f"""names AS (
  SELECT doc_id, kind || '_' || day || '_' || {part_sql("target")} || '_' || {part_sql("source")} || '_' ||
         CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END || '.pdf' AS file_name
  FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'industry' ELSE 'economy' END AS kind,
               strftime(DATE '2024-01-01' + (doc_id * 7 % 59)::INTEGER, '%Y-%m-%d') AS day,
               CASE WHEN doc_id % 3 = 2 THEN 'null' ELSE 'T' || (doc_id % 17) END AS target,
               {part_sql("text")} AS t FROM documents))"""
REPORTS = NAMES + """,
reports AS (
  SELECT doc_id, file_name, a[1] AS report_type, a[2] AS report_date, try_cast(a[2] AS DATE) AS report_dt, a[3] AS target_name,
         a[4] AS broker, array_to_string(a[5:], '_') AS title
  FROM (SELECT doc_id, file_name, string_split(regexp_replace(file_name, '(?i)\\.pdf$', ''), '_') AS a FROM names)
  WHERE len(a) >= 5 AND try_cast(a[2] AS DATE) IS NOT NULL),
done AS (SELECT n.file_name FROM names n WHERE doc_id IN (SELECT doc_id FROM labels))"""

DATE_SQL = "report_dt::VARCHAR AS report_dt"


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("report_dt", F.col("report_dt").cast("string"))


@query(f"WITH {REPORTS} SELECT report_type, report_date, {DATE_SQL}, target_name, title, broker, file_name, sha256(file_name) AS report_id, false AS is_embedded FROM reports")
def registry_parse(spark, sf_dir):
    return dated(reports(spark, sf_dir))


EDGE = (
    "company_2024-02-21_삼성전자_미래에셋증권_HBM 공급 확대 전망.pdf", "economy_2024-02-21_null_KB_주간_전망.pdf", "company_2024-2-1_A_B_T.PDF", "x_2024-02-21____.pdf",
    "company_2024-02-30_A_B_T.pdf", "company_2024-02-21_A_B.pdf", "note.txt", "industry_24-2-1_A_B_T.pdf", "a_2024-13-01_b_c_d.pdf",
)


def literals(spark: SparkSession, column: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def values_sql(values, alias: str) -> str:
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in ((v,) if isinstance(v, str) else v)) + ")" for v in values)
    return f"(VALUES {rows}) {alias}"


def one_of(values, number):
    """The value whose place is the number modulo their count."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def one_of_sql(values, number: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][(({number}) % {len(values)} + 1)::BIGINT]"


@query(f"""SELECT doc_id, f AS file_name, ok, CASE WHEN ok THEN a[1] END AS report_type, CASE WHEN ok THEN a[2] END AS report_date, CASE WHEN ok THEN d::VARCHAR END AS report_dt,
  CASE WHEN ok THEN a[3] END AS target_name, CASE WHEN ok THEN a[4] END AS broker, CASE WHEN ok THEN array_to_string(a[5:], '_') END AS title
FROM (SELECT *, coalesce(f ILIKE '%.pdf' AND len(a) >= 5 AND d IS NOT NULL, false) AS ok FROM (SELECT *, try_strptime(CASE WHEN regexp_full_match(a[2], '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN a[2] END, '%Y-%m-%d')::DATE AS d
  FROM (SELECT doc_id, f, string_split(regexp_replace(f, '(?i)\\.pdf$', ''), '_') AS a FROM (SELECT doc_id, replace({one_of_sql(EDGE, "doc_id")}, 'B', source || '_' || n_chars) AS f FROM documents))))""")
def registry_parse_edge(spark, sf_dir):
    """Names of odd forms, with sources and sizes of the documents in them."""
    odd = F.replace(one_of(EDGE, F.col("doc_id")), F.lit("B"), F.concat_ws("_", "source", "n_chars"))
    out = table(spark, sf_dir, "documents").select("doc_id", odd.alias("file_name")).withColumn("p", registry.parse_file_name(F.col("file_name")))
    return out.select("doc_id", "file_name", F.col("p").isNotNull().alias("ok"), "p.report_type", "p.report_date", F.col("p.report_dt").cast("string").alias("report_dt"), "p.target_name", "p.broker", "p.title")


@query(f"WITH {NAMES} SELECT doc_id, file_name FROM names")
def filename_build(spark, sf_dir):
    return names(spark, sf_dir)


@query(f"""WITH {REPORTS} SELECT broker, count(*)::BIGINT AS n_reports, max(report_dt)::VARCHAR AS latest_date, count(DISTINCT target_name)::BIGINT AS n_targets,
  arg_max(title, (report_dt, file_name)) AS latest_title FROM reports GROUP BY broker""")
def reports_by_broker_latest(spark, sf_dir):
    return registry.brokers_latest(reports(spark, sf_dir))


@query(f"WITH {REPORTS} SELECT report_type, count(*)::BIGINT AS n_reports FROM reports GROUP BY report_type")
def reports_count_by_type(spark, sf_dir):
    return registry.counts_by(reports(spark, sf_dir), "report_type")


@query(f"WITH {REPORTS} SELECT nullif(target_name, 'null') AS target, count(*)::BIGINT AS n_reports FROM reports GROUP BY 1")
def reports_by_null_target(spark, sf_dir):
    return registry.counts_by(registry.with_nullable_target(reports(spark, sf_dir)), "target")


COLUMNS = "file_name, report_type, report_date, target_name, broker, title"
LIST = [c.strip() for c in COLUMNS.split(",")]


@query(f"WITH {REPORTS} SELECT {COLUMNS} FROM reports WHERE file_name NOT IN (SELECT file_name FROM done)")
def reports_pending(spark, sf_dir):
    r = reports(spark, sf_dir)
    return registry.pending(registry.mark_embedded(r, done(spark, sf_dir))).select(*LIST)


@query(f"WITH {REPORTS} SELECT {COLUMNS} FROM reports WHERE file_name NOT IN (SELECT file_name FROM done) ORDER BY report_date DESC, file_name LIMIT 10")
def reports_pending_limit(spark, sf_dir):
    return registry.pending(registry.mark_embedded(reports(spark, sf_dir), done(spark, sf_dir)), 10).select(*LIST)


@query(f"WITH {REPORTS} SELECT {COLUMNS} FROM reports WHERE file_name IN (SELECT file_name FROM done)")
def reports_embedded(spark, sf_dir):
    return registry.with_source(reports(spark, sf_dir), done(spark, sf_dir)).select(*LIST)


@query(f"WITH {REPORTS} SELECT {COLUMNS} FROM reports ORDER BY report_date DESC, file_name LIMIT 5")
def reports_preview(spark, sf_dir):
    return registry.fetch_all(reports(spark, sf_dir)).limit(5).select(*LIST)


@query(f"WITH {REPORTS} SELECT {COLUMNS} FROM reports WHERE target_name ILIKE '%t1%'")
def reports_by_target(spark, sf_dir):
    return registry.by_target(reports(spark, sf_dir), "t1").select(*LIST)


@query(f"WITH {REPORTS} SELECT {COLUMNS} FROM reports WHERE report_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def reports_date_range(spark, sf_dir):
    return registry.by_dates(reports(spark, sf_dir), "2024-01-10", "2024-01-20").select(*LIST)


def overlapping(spark, sf_dir):
    """The first two thirds of the documents are registered, the last two thirds come in, some of them twice."""
    r = reports(spark, sf_dir, with_id=True)
    old, new = r.filter("doc_id % 3 < 2").drop("doc_id"), r.filter("doc_id % 3 > 0")
    return old, new.drop("doc_id").unionByName(new.filter("doc_id % 5 = 0").drop("doc_id"))


OVERLAP = REPORTS + """, old AS (SELECT * FROM reports WHERE doc_id % 3 < 2),
new AS (SELECT * FROM reports WHERE doc_id % 3 > 0 UNION ALL SELECT * FROM reports WHERE doc_id % 3 > 0 AND doc_id % 5 = 0)"""


@query(f"WITH {OVERLAP} SELECT DISTINCT {COLUMNS} FROM new WHERE file_name NOT IN (SELECT file_name FROM old)")
def registry_upsert_ignore(spark, sf_dir):
    return registry.insert_or_ignore(*overlapping(spark, sf_dir)).select(*LIST)


@query(f"""WITH {OVERLAP}, i AS (SELECT count(DISTINCT file_name)::BIGINT AS inserted FROM new WHERE file_name NOT IN (SELECT file_name FROM old)),
b AS (SELECT count(*)::BIGINT AS n_before FROM old), g AS (SELECT count(*)::BIGINT AS given FROM new)
SELECT n_before, n_before + inserted AS n_after, inserted, given - inserted AS skipped FROM i, b, g""")
def registry_upsert_counts(spark, sf_dir):
    return registry.insert_counts(*overlapping(spark, sf_dir))


@query("""WITH b AS (SELECT doc_id // 2 AS k, doc_id AS batch, n_chars FROM documents)
SELECT k, batch, n_chars FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch DESC) = 1""")
def chunk_upsert_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("k"), F.col("doc_id").alias("batch"), "n_chars")
    return registry.insert_or_replace(d, "k", "batch")


@query("""WITH d AS (SELECT doc_id, doc_id // 4 AS file, n_chars FROM documents)
SELECT doc_id, file, n_chars FROM d WHERE doc_id % 2 = 0 AND file % 3 <> 0 UNION ALL SELECT doc_id, file, -n_chars FROM d WHERE doc_id % 2 = 1 AND file % 3 = 0""")
def store_replace(spark, sf_dir):
    """A table by file after a second batch: the rows of every third file are replaced, those of others stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 4").alias("file"), "n_chars").withColumn("bucket", store.bucket_of(F.col("file"), 16))
    path, schema = f"{store.shared_dir(spark)}/files-{uuid.uuid4().hex}", "doc_id long, file long, n_chars long, bucket int"
    again = d.filter("file % 3 = 0").select("file")
    for batch in (d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1 AND file % 3 = 0").withColumn("n_chars", -F.col("n_chars"))):
        store.replace_rows(spark, path, schema, batch, batch.select("file").unionByName(again), "file", "bucket")
    out = store.kept(store.read_table(spark, path, schema).drop("bucket"), "files")
    store.remove(spark, path)
    return out


@query("SELECT count(*)::BIGINT AS n_rows, true AS has_files, true AS has_bytes FROM embeddings")
def stored_files(spark, sf_dir):
    """A stored table by its files' metadata alone, beside its rows."""
    kept = store.kept(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "stored")
    size = files.stored_size(spark, kept.kept_in).select((F.col("n_files") > 0).alias("has_files"), (F.col("n_bytes") > 0).alias("has_bytes"))
    out = store.kept(kept.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(size), "size")  # one row each
    store.remove(spark, kept.kept_in)
    return out


@query(f"WITH {REPORTS} SELECT CASE WHEN file_name IN (SELECT file_name FROM done) THEN 'success' ELSE 'failed' END AS status, count(*)::BIGINT AS n FROM reports GROUP BY 1")
def ingest_status(spark, sf_dir):
    r = registry.mark_embedded(reports(spark, sf_dir), done(spark, sf_dir))
    return r.groupBy(F.when(F.col("is_embedded"), "success").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS n_chunks, sum(4 * len(embedding))::BIGINT AS n_bytes FROM embeddings")
def index_size(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(4 * F.size("embedding")).alias("n_bytes"))


@query(f"WITH {REPORTS} SELECT file_name, target_name, title, report_date FROM reports")
def metadata_json(spark, sf_dir):
    """Through JSON and back, so that the fields can be compared."""
    fields = ("file_name", "target_name", "title", "report_date")
    j = reports(spark, sf_dir).select(F.to_json(F.struct(*fields)).alias("metadata"))
    return j.select(F.from_json("metadata", ", ".join(f"{f} string" for f in fields)).alias("m")).select("m.*")


# ---- listings -----------------------------------------------------------------------------------------------------


def listed(spark, sf_dir):
    """Reports as a listing: categories in order, the newest first within each but for every eleventh."""
    r = reports(spark, sf_dir, with_id=True)
    order = F.when(F.col("report_type") == "company", 0).when(F.col("report_type") == "industry", 1).otherwise(2)
    pos = F.when(F.col("doc_id") % 11 == 0, F.lit(0)).otherwise(F.datediff(F.lit("2024-03-01").cast("date"), "report_dt")) * 1_000_000 + F.col("doc_id")
    return r.select(
        F.col("report_type").alias("category"), order.alias("category_order"), pos.cast("long").alias("pos"), "file_name", "report_dt",
        F.when(F.col("doc_id") % 13 != 0, F.col("file_name")).alias("pdf_url"),
    )


LISTED = REPORTS + """, listed AS (SELECT report_type AS category, CASE report_type WHEN 'company' THEN 0 WHEN 'industry' THEN 1 ELSE 2 END AS category_order,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE date_diff('day', report_dt, DATE '2024-03-01') END * 1000000 + doc_id AS pos, file_name, report_dt,
  CASE WHEN doc_id % 13 <> 0 THEN file_name END AS pdf_url FROM reports)"""
SINCE = """SELECT category, pos, file_name, report_dt::VARCHAR AS report_dt FROM (
  SELECT *, min((report_dt >= {target})::INTEGER) OVER (PARTITION BY category ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ok FROM listed) WHERE ok = 1 AND pdf_url IS NOT NULL"""


@query(f"WITH {LISTED} " + SINCE.format(target="DATE '2024-01-05'"))
def listing_since(spark, sf_dir):
    return dated(listing.since(listed(spark, sf_dir), "2024-01-05").select("category", "pos", "file_name", "report_dt"))


@query(f"WITH {LISTED} " + SINCE.format(target="(SELECT arg_min(report_dt, (category_order, pos)) FROM listed)"))
def listing_default_date(spark, sf_dir):
    return dated(listing.since(listed(spark, sf_dir)).select("category", "pos", "file_name", "report_dt"))


@query(f"WITH {LISTED} SELECT max(report_dt)::VARCHAR AS latest_date FROM listed WHERE report_dt <= DATE '2024-02-15'")
def latest_day_select(spark, sf_dir):
    return listing.latest_day(listed(spark, sf_dir), "2024-02-15")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def listing_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(listing.links(F.col("html"))).alias("href"))


@query("SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def listing_h1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("h1"))


LISTED_TITLE = "'R_' || doc_id || ': A&B up?'"


@query(f"""SELECT category, target_name, title, broker, pdf_url, report_dt::VARCHAR AS report_dt, category || '_' || report_dt || '_' || target_name || '_' || {part_sql("broker")} || '_' || {part_sql("title")} || '.pdf' AS file_name
FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'industry' ELSE 'economy' END AS category, CASE WHEN doc_id % 3 = 2 THEN 'null' ELSE 'T' || (doc_id % 17) END AS target_name, {LISTED_TITLE} AS title,
  coalesce(source, 'none') AS broker, CASE WHEN doc_id % 7 <> 0 THEN '/f' || doc_id || '.PDF?x=1' END AS pdf_url, DATE '1996-11-01' + (doc_id % 9000)::INTEGER AS report_dt FROM documents WHERE doc_id % 13 <> 0)""")
def listing_table_rows(spark, sf_dir):
    """Listing pages of twenty documents each, made from the table and read again; the SQL has no pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("broker"))
    n = F.col("doc_id").cast("string")
    day = F.when(F.col("doc_id") % 13 == 0, "24.02.30").otherwise(F.date_format(F.date_add(F.lit("1996-11-01").cast("date"), (F.col("doc_id") % 9000).cast("int")), "yy.M.d"))
    link = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('<a href="f'), n, F.lit('.html">f</a>'))).otherwise(F.concat(F.lit('<a href="q.html">q</a><a class="c" href="/f'), n, F.lit('.PDF?x=1">f</a>')))
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    title = cell(F.concat(F.lit("<b>R_"), n, F.lit("</b>: A&amp;B up?")))
    target = F.when(F.col("doc_id") % 3 == 2, "").otherwise(cell(F.concat(F.lit("T"), (F.col("doc_id") % 17).cast("string"))))
    row = F.concat(F.lit("<tr>"), target, title, cell(F.col("broker")), cell(link), cell(day), cell(F.lit("9")), F.lit("</tr>"))
    kind = one_of(("company", "industry", "economy"), F.col("doc_id"))
    pages = d.groupBy(kind.alias("category"), F.expr("doc_id div 60").cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("r")))).alias("rows"))  # twenty at most
    body = F.array_join(F.transform("rows", lambda x: x["r"]), "")
    html = F.concat(F.lit("<p></p><table  summary='s' class='type_1'><tr><th>x</th></tr>"), body, F.lit("<tr><td>short</td></tr></table>"))
    found = listing.listing_rows(pages.select("category", "page", html.alias("html")))
    return dated(listing.with_file_name(found).select("category", "target_name", "title", "broker", "pdf_url", "report_dt", "file_name"))


@query(f"""WITH {LISTED}, t AS (SELECT DISTINCT file_name FROM listed) SELECT count(*)::BIGINT AS n_taken, count(*) FILTER (WHERE file_name IN (SELECT file_name FROM done))::BIGINT AS n_present FROM t""")
def crawl_counts(spark, sf_dir):
    """Of the listed files, how many are there already."""
    return listing.crawl_count(listed(spark, sf_dir), done(spark, sf_dir))


@query(f"WITH {LISTED}, s AS ({SINCE.format(target="DATE '2024-01-05'")}) SELECT category, pos, file_name FROM s WHERE file_name NOT IN (SELECT file_name FROM done)")
def crawl_todo(spark, sf_dir):
    """What a run fetches: the listed files since a date that aren't there yet."""
    return registry.unfinished(listing.since(listed(spark, sf_dir), "2024-01-05"), done(spark, sf_dir)).select("category", "pos", "file_name")


DAYS = ("yy.MM.dd", "yy.M.d", "yyyy.MM.dd", "yy-MM-dd", "yy.MM.'31'", "yy.'13'.dd")


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%y.%m.%d') WHEN 1 THEN strftime(o_orderdate, '%y.%-m.%-d') WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 3 THEN strftime(o_orderdate, '%y-%m-%d')
  WHEN 4 THEN strftime(o_orderdate, '%y.%m.31') ELSE strftime(o_orderdate, '%y.13.%d') END AS s FROM orders)
SELECT o_orderkey, s, CASE WHEN regexp_full_match(s, '\\d{2}\\.\\d{1,2}\\.\\d{1,2}') THEN try_strptime(CASE WHEN try_cast(s[1:2] AS INTEGER) >= 69 THEN '19' ELSE '20' END || s, '%Y.%m.%d')::DATE::VARCHAR END AS d FROM f""")
def date_yy_pivot(spark, sf_dir):
    """Dates of orders in six spellings, two of them no dates at times."""
    o = table(spark, sf_dir, "orders")
    s = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in DAYS]), (F.col("o_orderkey") % len(DAYS) + 1).cast("int"))
    return o.select("o_orderkey", s.alias("s")).withColumn("d", X.short_year_date(F.col("s")).cast("string"))


# ---- cleaning -----------------------------------------------------------------------------------------------------

MARKERS = (*R.CUT_MARKERS, "License", "license")
RULES = R.Rules(cut_markers=MARKERS)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has_sql(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in phrases) + ")"


def cut_sql(x: str, markers) -> str:
    places = ", ".join(f"CASE WHEN strpos({x}, {quoted(m)}) > 1 THEN strpos({x}, {quoted(m)}) END" for m in markers)
    return f"regexp_replace(substr({x}, 1, coalesce(least({places}), length({x}) + 1) - 1), '{WS}+$', '')"


def hangul_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[가-힣]'))"


def sidebar_sql(b: str) -> str:
    lines = f"list_filter(list_transform(string_split({b}, chr(10)), lambda q: {strip_sql('q')}), lambda q: q <> '')"
    short = f"list_filter({lines}, lambda q: length(q) < 25 AND {hangul_sql('q')} BETWEEN 2 AND 9)"
    return f"({has_sql(b, R.SIDEBAR_MARKERS)} OR (length({b}) < 300 AND {has_sql(b, R.SIDEBAR_TERMS)}) OR (len({lines}) >= 6 AND len({short}) >= 0.75 * len({lines})))"


def noise_sql(line: str) -> str:
    s = strip_sql(line)
    numeric = quoted("|".join(f"(?:{p})" for p in R.NUMERIC))
    captions = quoted("(?i)" + "|".join(f"(?:{p})" for p in R.CAPTIONS))
    labels = quoted("|".join(R.ROW_LABELS))
    tokens = f"list_filter(regexp_split_to_array({s}, '{WS}+'), lambda w: w <> '')"
    return (
        f"CASE WHEN {s} = '' THEN false WHEN {has_sql(s, R.DISCLAIMERS)} THEN true WHEN regexp_matches({s}, {captions}) THEN true"
        f" WHEN {s} IN ({', '.join(map(quoted, R.LABELS))}) THEN true WHEN length({s}) < 35 AND regexp_matches({s}, {labels}) AND {hangul_sql(s)} < 14 THEN true"
        f" WHEN {hangul_sql(s)} >= 13 THEN false WHEN length({s}) < 20 AND {hangul_sql(s)} <= 6 THEN true"
        f" ELSE len(list_filter({tokens}, lambda w: regexp_matches(w, {numeric}))) >= 0.5 * len({tokens}) END"
    )


@query(f"SELECT doc_id, {cut_sql('text', MARKERS)} AS body FROM documents")
def clean_cut_section(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_section(F.col("text"), MARKERS).alias("body"))


@query(f"SELECT doc_id, n, noise, line FROM (SELECT *, {noise_sql('line')} AS noise FROM (SELECT doc_id, unnest(range(len(l)))::INTEGER AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))")
def clean_noise_line(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.withColumn("noise", X.noise_line(F.col("line")))


KOREAN = (
    "", "  ", "기준일: 2026년 2월 1일", "자료: 회사 자료, 리서치센터", "source: x", "PER", " 현재가 ", "매출채권 1,234 1,300", "Financial Ratio", "전년 동기 대비 매출 증가율은 시장 기대치를 상회",
    "가나다라마바사아자차증가율", "# 요약", "1Q22 2Q22 3Q22 4Q22 1Q23 2Q23", "Consolidated 1,200 -3.5% growth", "sales 1,200 1,300 growth rates ok", "Revenue grew strongly in the quarter",
    "그림 1. 매출 추이와 전망을 함께 나타낸 그림", "figure 12 shows something of interest here", "주1: 연결 기준", "가나다라마바사 abcdefg hijk", "N/A NA - + 2024.1 3조원 long words here ok", "![img](a.png)",
)


@query(f"SELECT doc_id, line, {noise_sql('line')} AS noise FROM (SELECT doc_id, replace(replace({one_of_sql(KOREAN, 'doc_id')}, '1', (doc_id % 10)::VARCHAR), '가', substr(lang, 1, (doc_id % 2)::BIGINT)) AS line FROM documents)")
def clean_noise_line_ko(spark, sf_dir):
    """Lines as Korean reports have them, with digits and letters that change from document to document."""
    changed = F.replace(one_of(KOREAN, F.col("doc_id")), F.lit("1"), (F.col("doc_id") % 10).cast("string"))
    changed = F.replace(changed, F.lit("가"), F.col("lang").substr(F.lit(1), (F.col("doc_id") % 2).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", changed.alias("line")).withColumn("noise", X.noise_line(F.col("line")))


_SHORT, _LONG = "가나다라 12", "This line is long enough not to be a label at all"
BLOCKS = (
    "a STOCK DATA b", "x" * 291 + " 주요주주 ", "x" * 295 + "주요주주", "\n".join([_SHORT] * 6 + [_LONG] * 2), "\n".join([_SHORT] * 5 + [_LONG] * 3), "\n".join([_SHORT] * 5), "\n\n".join([_SHORT] * 6), "plain text",
)


@query(f"SELECT block, {sidebar_sql('block')} AS sidebar FROM {values_sql(BLOCKS, 't(block)')} UNION ALL SELECT html, {sidebar_sql('html')} FROM pages")
def clean_sidebar_block(spark, sf_dir):
    both = literals(spark, "block", BLOCKS).unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("block")))
    return both.select("block", X.sidebar_block(F.col("block")).alias("sidebar"))


def clean_sql(t: str, markers, separator: str = "chr(10) || chr(10)") -> str:
    """Unnested to lines and back, as DuckDB does not like deeply nested lambdas."""
    return f"""
l AS (SELECT k, b, block, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT k, b, block, string_split(block, chr(10)) AS a FROM
  (SELECT k, unnest(range(len(bs))) AS b, unnest(bs) AS block FROM (SELECT k, string_split({cut_sql(t, markers)}, {separator}) AS bs FROM src)) WHERE NOT {sidebar_sql('block')})),
blocks AS (SELECT k, b, {strip_sql("string_agg(line, chr(10) ORDER BY i)")} AS t FROM l WHERE NOT ({noise_sql('line')}) GROUP BY k, b),
cleaned AS (SELECT src.k, coalesce(c.t, '') AS cleaned FROM src LEFT JOIN (SELECT k, string_agg(t, {separator} ORDER BY b) AS t FROM blocks WHERE t <> '' GROUP BY k) c ON src.k = c.k)"""


@query(f"""WITH src AS (SELECT doc_id AS k, text FROM documents), {clean_sql("text", MARKERS)}
SELECT k AS doc_id, cleaned, length(cleaned)::INTEGER AS n_chars, CASE WHEN {strip_sql('text')} = '' THEN 'no text' WHEN cleaned = '' THEN 'nothing left after cleaning' END AS error FROM cleaned JOIN src USING (k)""")
def clean_document(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = d.select("doc_id", "text", F.explode(F.array(X.clean_document(F.col("text"), RULES))).alias("cleaned"))
    return out.select("doc_id", "cleaned", F.length("cleaned").alias("n_chars"), X.cleaning_error(F.col("text"), F.col("cleaned")).alias("error"))


TEXTS = ("본문\nCompliance Notice\nx", "Compliance Notice\n본문입니다 그리고 조금 더 길게 써 봅니다", "STOCK DATA 1\n\n이 문장은 충분히 길어서 지워지지 않고 남습니다\nPER\n\n" + "\n".join([_SHORT] * 7) + "\n\n끝 문장도 충분히 길어서 지워지지 않고 남습니다  ", " \n ")


@query(f"""WITH src AS (SELECT conv_id * 100000 + turn AS k, {one_of_sql(TEXTS, "turn + conv_id")} || chr(10) || chr(10) || coalesce(text, '') AS text FROM conversations), {clean_sql("text", R.CUT_MARKERS)}
SELECT k // 100000 AS conv_id, k % 100000 AS turn, cleaned FROM cleaned""")
def clean_document_ko(spark, sf_dir):
    """Entries of conversations, each behind a Korean passage that has to be cleaned."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(one_of(TEXTS, F.col("turn") + F.col("conv_id")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", X.clean_document(text).alias("cleaned"))


# ---- chunks -------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, i::INTEGER AS chunk_index, substr(text, (i * 450 + 1)::BIGINT, 500) AS chunk FROM (
  SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 500) / 450.0), 0)::BIGINT + 1)) AS i FROM documents)""")
def chunk_fixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.fixed_windows(F.col("text"), 500, 50)).alias("chunk_index", "chunk"))


def markdown(spark, sf_dir):
    html = F.regexp_replace(F.regexp_replace("html", "(?s)<h1[^>]*>", "\n# "), "</p>|</h1>", "\n\n")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(html, F.lit("\n## part\nmore\n### deep\ntext\n# last\n\nend")).alias("text"))


@query("""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<h1[^>]*>', chr(10) || '# ', 'g'), '</p>|</h1>', chr(10) || chr(10), 'g')
    || chr(10) || '## part' || chr(10) || 'more' || chr(10) || '### deep' || chr(10) || 'text' || chr(10) || '# last' || chr(10) || chr(10) || 'end' AS t FROM pages),
l AS (SELECT page_id, unnest(range(len(a))) AS n, unnest(a) AS line FROM (SELECT page_id, string_split(t, chr(10)) AS a FROM m)),
h AS (SELECT *, length(regexp_extract(line, '^(#{1,3}) +(.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,3}) +(.*)$', 2), ' ') AS title FROM l),
s AS (SELECT *, sum((level > 0)::INTEGER) OVER (PARTITION BY page_id ORDER BY n) AS section FROM h),
g AS (SELECT page_id, section::BIGINT AS section, max(CASE WHEN level > 0 THEN level END) AS level, max(CASE WHEN level > 0 THEN title END) AS title, string_agg(line, chr(10) ORDER BY n) AS content FROM s GROUP BY 1, 2)
SELECT page_id, section, content,
  (SELECT arg_max(title, section) FROM g o WHERE o.page_id = g.page_id AND o.section <= g.section AND o.level = 1) AS h1,
  (SELECT CASE WHEN max(CASE WHEN o.level = 2 THEN section END) > coalesce(max(CASE WHEN o.level < 2 THEN section END), -1) THEN arg_max(title, CASE WHEN o.level = 2 THEN section END) END FROM g o WHERE o.page_id = g.page_id AND o.section <= g.section) AS h2,
  (SELECT CASE WHEN max(CASE WHEN o.level = 3 THEN section END) > coalesce(max(CASE WHEN o.level < 3 THEN section END), -1) THEN arg_max(title, CASE WHEN o.level = 3 THEN section END) END FROM g o WHERE o.page_id = g.page_id AND o.section <= g.section) AS h3
FROM g WHERE trim(replace(content, chr(10), ''), ' ') <> ''""")
def chunk_header_sections(spark, sf_dir):
    return chunk.header_sections(markdown(spark, sf_dir), "text", ("page_id",)).select("page_id", "section", "content", "h1", "h2", "h3")


@query(f"""WITH {REPORTS}, w AS (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 500) / 450.0), 0)::BIGINT + 1)) AS i FROM documents)
SELECT r.doc_id, i::INTEGER AS chunk_index, '[기업: ' || target_name || ', 제목: ' || title || ']' || chr(10) || substr(w.text, (i * 450 + 1)::BIGINT, 500) AS chunk, sha256(r.file_name || chr(1) || i::VARCHAR) AS chunk_id
FROM reports r JOIN w ON r.doc_id = w.doc_id""")
def chunk_context_prefix(spark, sf_dir):
    """Every window of a document under its context prefix."""
    r = reports(spark, sf_dir, with_id=True).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    r = r.select("doc_id", "file_name", "target_name", "title", F.posexplode(chunk.fixed_windows(F.col("text"), 500, 50)).alias("chunk_index", "window"))
    text = F.concat(chunk.context_prefix(F.col("target_name"), F.col("title")), F.col("window"))
    return r.select("doc_id", "chunk_index", text.alias("chunk"), chunk.chunk_id(F.col("file_name"), F.col("chunk_index")).alias("chunk_id"))


QUERIES["chunk_context_prefix_all"], SQL["chunk_context_prefix_all"] = QUERIES["chunk_context_prefix"], SQL["chunk_context_prefix"]


@query()
def chunk_recursive_stats(spark, sf_dir):
    """Parents and children of all documents: how many, and how long."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    parents = chunk.recursive_chunks(d, "text", 2000, 200, "parent_index", "parent")
    children = chunk.recursive_chunks(parents, "parent", 500, 50, "child_index", "child")
    return children.groupBy("doc_id").agg(F.count_distinct("parent_index").alias("n_parents"), F.count(F.lit(1)).alias("n_children"), F.max(F.length("child")).alias("longest"))


@query()
def chunk_udtf_stats(spark, sf_dir):
    """chunk_recursive_stats in SQL alone, through the splitter as a table function."""
    udtf.register(spark)
    view = f"documents_{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView(view)
    try:
        return spark.sql(f"""SELECT p.doc_id, count(DISTINCT p.parent_index) AS n_parents, count(*) AS n_children, max(length(c.chunk)) AS longest
FROM (SELECT doc_id, chunk_index AS parent_index, chunk AS parent FROM split_table(TABLE(SELECT doc_id, text FROM {view}), 'text', 2000, 200)) p, LATERAL split_text(p.parent, 500, 50) c GROUP BY p.doc_id""")
    finally:
        spark.catalog.dropTempView(view)


# ---- retrieval ----------------------------------------------------------------------------------------------------

K = 5


def chunks(spark, sf_dir):
    """Vectors as chunks: five in a row share a parent, every seventh has none; parents are documents of that id."""
    parent = F.when(F.col("vec_id") % 7 != 0, F.expr("vec_id div 5"))
    return table(spark, sf_dir, "embeddings").select("vec_id", parent.alias("parent_id"), "label", "embedding")


def hits(spark, sf_dir):
    v = chunks(spark, sf_dir)
    found = retrieve.knn(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, K, chunk_id="vec_id")
    return found.withColumn("score", F.round("score", 6))


def expanded(spark, sf_dir):
    h = hits(spark, sf_dir).join(chunks(spark, sf_dir).drop("embedding"), "vec_id").withColumn("text", F.concat(F.lit("chunk "), F.col("vec_id").cast("string")))
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("content"))
    return retrieve.with_parent_text(retrieve.one_per_parent(h), parents)


def passages(spark, sf_dir):
    """The three passages of each query with the report of the document of the vector's number."""
    r = reports(spark, sf_dir, with_id=True).select("doc_id", "target_name", "report_date", "title", "broker", "file_name")
    return retrieve.top_passages(expanded(spark, sf_dir)).join(r, F.col("vec_id") == F.col("doc_id"), "left").drop("doc_id")


HITS = """v AS (SELECT vec_id, label, CASE WHEN vec_id % 7 <> 0 THEN vec_id // 5 END AS parent_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, c.parent_id, c.label, round(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score FROM v q, v c WHERE q.vec_id % 50 = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 5)"""
EXPANDED = HITS + """, one AS (SELECT * FROM hits QUALIFY parent_id IS NULL OR row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1),
expanded AS (SELECT one.*, coalesce(nullif(d.text, ''), 'chunk ' || vec_id) AS text FROM one LEFT JOIN documents d ON d.doc_id = parent_id)"""
PASSAGES = REPORTS + ", " + EXPANDED + """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS place FROM expanded QUALIFY place <= 3),
passages AS (SELECT top.*, r.target_name, r.report_date, r.title, r.broker, r.file_name FROM top LEFT JOIN reports r ON r.doc_id = vec_id)"""


@query(f"WITH {HITS} SELECT query_id, vec_id, score, rank FROM hits")
def knn_topk(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {HITS} SELECT query_id, vec_id, score, rank FROM hits")
def knn_clustered(spark, sf_dir):
    """The search of knn_topk through a stored index of clusters."""
    v = chunks(spark, sf_dir)
    path = f"{store.shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    index = VectorIndex(spark, path, "vec_id long, parent_id long, label int, embedding array<float>", id="vec_id", owner="vec_id")
    index.put(v)
    found = index.search(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), K)
    index.drop()
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {HITS.replace('FROM v q, v c WHERE q.vec_id % 50 = 0', 'FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.label = 1')} SELECT query_id, vec_id, score, rank FROM hits")
def knn_filtered(spark, sf_dir):
    """A metadata filter below the search (an extension)."""
    v = chunks(spark, sf_dir)
    found = retrieve.knn(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.filter("label = 1"), K, chunk_id="vec_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {EXPANDED} SELECT query_id, vec_id, parent_id, rank FROM one")
def knn_dedup_parent(spark, sf_dir):
    return retrieve.one_per_parent(hits(spark, sf_dir).join(chunks(spark, sf_dir).drop("embedding"), "vec_id")).select("query_id", "vec_id", "parent_id", "rank")


@query(f"WITH {EXPANDED} SELECT query_id, vec_id, rank, text FROM expanded")
def knn_expand_parent(spark, sf_dir):
    return expanded(spark, sf_dir).select("query_id", "vec_id", "rank", "text")


@query(f"""WITH {PASSAGES} SELECT query_id, string_agg(chr(10) || '--- 문서 ' || place || ' ---' || chr(10) || '[출처: [' || place || '] ' || coalesce(target_name, '알수없음') || ' (' || coalesce(report_date, '날짜없음') || ') - '
  || coalesce(title, '제목없음') || ']' || chr(10) || text || chr(10), '' ORDER BY place) AS context FROM passages GROUP BY query_id""")
def knn_context(spark, sf_dir):
    return retrieve.context(passages(spark, sf_dir))


@query(f"WITH {PASSAGES} SELECT query_id, place AS rank, coalesce(target_name, '-') AS target_name, coalesce(report_date, '-') AS report_date, coalesce(broker, '-') AS broker, coalesce(file_name, '-') AS file_name, score FROM passages")
def knn_hit_report(spark, sf_dir):
    return retrieve.hit_report(passages(spark, sf_dir))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {EXPANDED}, scored AS (SELECT query_id, vec_id, rank, round(len(list_intersect({WORDS.format("'the of " + "chunk'")}, {WORDS.format("text")})) / 3.0, 6) AS score FROM expanded)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INTEGER AS place FROM scored QUALIFY place <= 3""")
def knn_rerank_overlap(spark, sf_dir):
    h = expanded(spark, sf_dir).select("query_id", "vec_id", "rank", "text")
    return retrieve.rerank(h, F.lit("the of chunk"), F.col("text")).drop("text")


@query()
def embed_search(spark, sf_dir):
    """Documents embedded by the offline embedder, and every fiftieth asked for its nearest."""
    d = table(spark, sf_dir, "documents").select("doc_id", retrieve.embed(F.col("text"), retrieve.HashingEmbedder()).alias("embedding"))
    asked = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), retrieve.embed(F.col("text"), retrieve.HashingEmbedder(), "retrieval_query").alias("embedding"))
    return retrieve.knn(asked, d, 1, chunk_id="doc_id")


for _name in ("topk", "filtered", "dedup_parent", "expand_parent", "context", "hit_report", "rerank_overlap"):  # their names in round 1
    QUERIES[f"knn_{_name}_50"], SQL[f"knn_{_name}_50"] = QUERIES[f"knn_{_name}"], SQL[f"knn_{_name}"]


# ---- guarded SQL --------------------------------------------------------------------------------------------------

STATEMENTS = (
    ("SELECT broker, count(*) FROM reports GROUP BY broker", "accept"), ("SELECT * FROM reports WHERE file_name IN (SELECT file_name FROM Reports)", "accept"), ("SELECT * FROM (SELECT 1 UNION SELECT 2) t", "accept"), ("SELECT 1", "accept"),
    ("SELECT DISTINCT broker FROM reports ORDER BY broker LIMIT 3", "accept"), ("SELECT title FROM reports UNION SELECT broker FROM reports", "kind"), ("SELECT * FROM parent_chunks", "table"),
    ("SELECT EXISTS(SELECT 1 FROM other)", "table"), ("WITH x AS (SELECT * FROM reports) SELECT * FROM x", "table"), ("WITH x AS (SELECT * FROM secret) SELECT 1", "table"), ("DELETE FROM reports", "kind"), ("DROP TABLE reports", "kind"),
    ("DROP TABLE other", "table"), ("SELECT 1; DROP TABLE reports", "parse"), ("SELECT * FROM parquet.`/path`", "table"), ("SELECT * FROM a.reports", "table"), ("SELECT * FROM range(5)", "table"), ("SELEC x", "parse"),
    ("SELECT java_method('java.lang.System', 'exit', 1)", "function"), ("SHOW TABLES", "kind"), ("SET a = 1", "kind"), ("INSERT INTO reports SELECT * FROM reports", "kind"), ("EXPLAIN SELECT 1", "kind"),
)


def _counted(sql: str, n: int) -> str:
    return f"(SELECT count(*) FROM ({sql}) s{n})"


@query(f"WITH {REPORTS} " + " UNION ALL ".join(f"SELECT {quoted(s)} AS statement, {quoted(v)} AS verdict, {_counted(s, i) if v == 'accept' else '-1'}::BIGINT AS n_rows" for i, (s, v) in enumerate(STATEMENTS)))
def guard_accept_reject(spark, sf_dir):
    """What the guard says of each statement, and how many rows of the reports those it accepts give."""
    r, out = reports(spark, sf_dir), None
    for sql, _ in STATEMENTS:
        said = sqlguard.check(spark, sql)
        rows = spark.range(1).select(F.lit(-1).cast("long").alias("n_rows")) if said else sqlguard.run(spark, sql, r).agg(F.count(F.lit(1)).alias("n_rows"))
        one = rows.select(F.lit(sql).alias("statement"), F.lit(said.reason if said else "accept").alias("verdict"), "n_rows")
        out = out.unionByName(one) if out is not None else one
    return out


PASSTHROUGH = {
    "agg": "SELECT report_type, broker, count(*) AS n, count(DISTINCT target_name) AS n_targets, min(report_date) AS first_date FROM reports GROUP BY report_type, broker HAVING count(*) > 1",
    "window": "SELECT file_name, row_number() OVER (PARTITION BY broker ORDER BY report_date DESC, file_name) AS n, lag(report_date) OVER (PARTITION BY broker ORDER BY report_date, file_name) AS previous FROM reports",
    "subquery": "SELECT file_name, (SELECT max(report_date) FROM reports b WHERE b.broker = a.broker) AS latest FROM reports a WHERE EXISTS (SELECT 1 FROM reports c WHERE c.target_name = a.target_name AND c.report_date > a.report_date)",
    "setop": "SELECT * FROM (SELECT broker FROM reports WHERE report_type = 'company' INTERSECT SELECT broker FROM reports WHERE report_type = 'economy') t",
    "selfjoin": "SELECT a.file_name, b.file_name AS other FROM reports a JOIN reports b ON a.broker = b.broker AND a.target_name = b.target_name AND a.file_name < b.file_name",
    "cross": "SELECT a.report_type, b.broker FROM (SELECT DISTINCT report_type FROM reports) a CROSS JOIN (SELECT DISTINCT broker FROM reports) b",
    "leftjoin": "SELECT a.file_name, b.file_name AS other FROM reports a LEFT JOIN reports b ON a.target_name = b.target_name AND a.report_date = b.report_date AND b.report_type = 'industry' AND a.file_name <> b.file_name",
}


def _passthrough(name: str, sql: str):
    def run(spark, sf_dir):
        return sqlguard.run(spark, sql, reports(spark, sf_dir))

    run.__name__ = f"sql_passthrough_{name}"
    return query(f"WITH {REPORTS} {sql}")(run)


for _name, _sql in PASSTHROUGH.items():
    _passthrough(_name, _sql)


# ---- conversations, prices ----------------------------------------------------------------------------------------


def history(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", "text")


@query("SELECT conv_id AS thread_id, turn AS seq, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_last3(spark, sf_dir):
    return session.last_entries(history(spark, sf_dir)).select("thread_id", "seq", "role")


@query(f"""WITH h AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id AS thread_id, {strip_sql("string_agg('[' || role || ']' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn)")} AS history FROM h GROUP BY conv_id""")
def history_text(spark, sf_dir):
    return session.history_text(session.last_entries(history(spark, sf_dir)))


@query("SELECT conv_id AS thread_id, substr(arg_min(text, turn), 1, 15) || '...' AS name FROM conversations WHERE role = 'user' GROUP BY conv_id")
def thread_names(spark, sf_dir):
    return session.thread_names(history(spark, sf_dir))


@query("""WITH f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT c.thread_id, c.question, c.question || ' / ' || coalesce(h.n, 0) AS rewritten_query FROM
  (SELECT conv_id AS thread_id, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id) c LEFT JOIN (SELECT conv_id, count(*) AS n FROM f WHERE n <= 3 GROUP BY conv_id) h ON h.conv_id = c.thread_id""")
def query_rewrite(spark, sf_dir):
    h = history(spark, sf_dir)
    asked = h.groupBy("thread_id").agg(F.max_by("text", "seq").alias("question"))
    count = lambda q, past: F.concat(q, F.lit(" / "), F.regexp_count(past, F.lit(r"(?m)^\[(user|assistant|system)\]$")).cast("string"))
    return session.rewrite(asked, h, count).select("thread_id", "question", "rewritten_query")


@query("""WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 3),
h AS (SELECT conv_id, """ + strip_sql("string_agg('[' || role || ']' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn, role, text)") + """ AS history FROM l GROUP BY conv_id)
SELECT c.conv_id AS thread_id, count(*)::BIGINT AS n_entries, max(turn)::BIGINT AS last_seq, any_value(history) AS history FROM conversations c JOIN h ON h.conv_id = c.conv_id GROUP BY c.conv_id""")
def conversation_state(spark, sf_dir):
    """What a stream over all conversations knows of each thread in the end."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a file or a folder
    entries = turns.select(F.col("conv_id").cast("long").alias("thread_id"), F.col("turn").cast("long").alias("seq"), "role", "text")
    path = f"{store.shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
    run = conversations.keep_conversations(entries, f"{path}/states", f"{path}/checkpoint")
    run.awaitTermination()
    out = store.kept(conversations.states_of(spark, f"{path}/states"), "states")
    store.remove(spark, path)
    return out


ROUTES = (" RDB ", "stock_price", "foo", "vectordb", "", "Rdb\n")


@query(f"SELECT conv_id, turn, r, CASE WHEN lower({strip_sql('r')}) IN ('rdb', 'vectordb', 'stock_price') THEN lower({strip_sql('r')}) ELSE 'vectordb' END AS route FROM (SELECT conv_id, turn, replace({one_of_sql(ROUTES, 'turn + conv_id')}, 'foo', role) AS r FROM conversations)")
def route_normalise(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.replace(one_of(ROUTES, F.col("turn") + F.col("conv_id")), F.lit("foo"), F.col("role"))
    return c.select("conv_id", "turn", said.alias("r")).withColumn("route", session.normal_route(F.col("r")))


@query("""WITH q AS (SELECT conv_id, text, CASE WHEN regexp_matches(lower(text), 'how many|list of|latest report|목록|개수|몇 개|몇 건|발간일|제목|최근 리포트') THEN 'rdb' ELSE 'vectordb' END AS route FROM conversations WHERE role = 'user')
SELECT route, count(*)::BIGINT AS n FROM q GROUP BY route""")
def route_branches(spark, sf_dir):
    q = history(spark, sf_dir).filter("role = 'user'").withColumn("route", session.keyword_route(F.col("text")))
    catalog, texts = session.branches(q)
    return catalog.unionByName(texts).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


FENCED = ("```sql\n~\n```", "~", " ```~``` ")


@query(f"SELECT conv_id, turn, {strip_sql("regexp_replace(s, '```(sql)?', '', 'g')")} AS sql FROM (SELECT conv_id, turn, replace({one_of_sql(FENCED, 'turn + conv_id')}, '~', coalesce(text, '')) AS s FROM conversations)")
def strip_fences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    fenced = F.replace(one_of(FENCED, F.col("turn") + F.col("conv_id")), F.lit("~"), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", X.without_fences(fenced).alias("sql"))


@query("SELECT doc_id, '[질문]' || chr(10) || lang || ' / ' || source AS prompt, source || lang AS answer FROM documents")
def prompt_render(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = F.array(F.struct(F.col("source").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.col("lang").alias("text")))
    return d.select("doc_id", X.fill("[질문]\n{a} / {b}", a=F.col("lang"), b=F.col("source")).alias("prompt"), X.joined_parts(parts).alias("answer"))


@query("""WITH n AS (SELECT DISTINCT name_asked FROM (SELECT p_name AS name_asked FROM part UNION ALL SELECT substr(p_name, 3, length(p_name) - 3) FROM part UNION ALL SELECT 'no such name')),
m AS (SELECT name_asked, p_name AS name, p_partkey::VARCHAR AS code FROM n JOIN part ON contains(p_name, name_asked)),
b AS (SELECT *, row_number() OVER (PARTITION BY name_asked ORDER BY name <> name_asked, code, name) AS k FROM m)
SELECT n.name_asked, b.name, b.code FROM n LEFT JOIN b ON n.name_asked = b.name_asked AND k = 1""")
def ticker_resolve(spark, sf_dir):
    """Every part name, whole and from the inside."""
    p = table(spark, sf_dir, "part")
    inside = p.select(F.expr("substr(p_name, 3, length(p_name) - 3)").alias("name_asked"))
    asked = p.select(F.col("p_name").alias("name_asked")).unionByName(inside).unionByName(literals(spark, "name_asked", ["no such name"]))
    return prices.resolve_tickers(asked, p.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("code")))


QUERIES["ticker_resolve_all"], SQL["ticker_resolve_all"] = QUERIES["ticker_resolve"], SQL["ticker_resolve"]


@query("""WITH p AS (SELECT o_custkey::VARCHAR AS ticker, o_orderdate::DATE AS trade_date, o_totalprice AS close, o_orderkey AS volume FROM orders),
w AS (SELECT * FROM p WHERE trade_date >= (SELECT max(trade_date) FROM p) - 400 - 14 AND trade_date <= (SELECT max(trade_date) FROM p) - 400)
SELECT ticker, trade_date::VARCHAR AS trade_date, close, volume FROM w QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC, close DESC, volume DESC) <= 5""")
def recent_prices(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("volume")
    )
    as_of = p.agg(F.date_sub(F.max("trade_date"), 400).cast("string").alias("d")).first().d
    return prices.recent_prices(p, as_of).withColumn("trade_date", F.col("trade_date").cast("string"))


def quotes(spark, sf_dir):
    """Orders as prices of the reports' targets, moved to their years."""
    ticker = F.concat(F.lit("T"), (F.col("o_custkey") % 17).cast("string"))
    return table(spark, sf_dir, "orders").select(ticker.alias("target_name"), F.date_add(F.col("o_orderdate").cast("date"), 9400).alias("trade_date"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("volume"))


QUOTES = "quotes AS (SELECT 'T' || (o_custkey % 17) AS target_name, o_orderdate::DATE + 9400 AS trade_date, o_totalprice AS close, o_orderkey AS volume FROM orders)"


@query(f"""WITH {REPORTS}, {QUOTES}, q AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY target_name, trade_date ORDER BY trade_date, close DESC, volume DESC) = 1)
SELECT r.doc_id, r.target_name, r.report_date, q.trade_date::VARCHAR AS trade_date, q.close FROM reports r ASOF LEFT JOIN q ON r.target_name = q.target_name AND r.report_dt >= q.trade_date""")
def price_as_of_report(spark, sf_dir):
    """The last price of each report's target on its date or before."""
    r = reports(spark, sf_dir, with_id=True).select("doc_id", "target_name", "report_date", "report_dt")
    q = quotes(spark, sf_dir).withColumn("day", F.col("trade_date"))
    out = asof.asof_join(r, q, ["target_name"], "report_dt", "day", ["close", "volume", "trade_date"])
    return out.select("doc_id", "target_name", "report_date", F.col("trade_date").cast("string").alias("trade_date"), "close")


@query(f"""WITH {REPORTS}, {QUOTES}
SELECT doc_id, count(*)::BIGINT AS n_quotes, min(close) AS lowest, max(close) AS highest FROM reports r JOIN quotes q ON r.target_name = q.target_name AND trade_date BETWEEN report_dt - 6 AND report_dt GROUP BY doc_id""")
def prices_in_report_week(spark, sf_dir):
    """Prices of each report's target in the seven days up to its date."""
    r = reports(spark, sf_dir, with_id=True).select("doc_id", "target_name", "report_dt")
    week = asof.interval_join(quotes(spark, sf_dir), r, ["target_name"], F.unix_date("trade_date"), F.unix_date("report_dt") - 6, F.unix_date("report_dt"))
    return week.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.min("close").alias("lowest"), F.max("close").alias("highest"))


# ---- levels and sketches ------------------------------------------------------------------------------------------


@query(f"""WITH {REPORTS}, m AS (SELECT report_type, broker, substr(report_date, 1, 7) AS month, target_name, file_name FROM reports)
SELECT report_type, broker, month, grouping_id(report_type, broker, month)::BIGINT AS level, count(*)::BIGINT AS n_reports, count(DISTINCT target_name)::BIGINT AS n_targets FROM m GROUP BY CUBE (report_type, broker, month)""")
def reports_cube(spark, sf_dir):
    """Reports by type, broker and month, and by every subset of these."""
    r = reports(spark, sf_dir).withColumn("month", F.substring("report_date", 1, 7))
    return rollup.cube_counts(r, {c: F.col(c) for c in ("report_type", "broker", "month")}, n_reports=F.count(F.lit(1)), n_targets=F.count_distinct("target_name"))


@query("""WITH d AS (SELECT ts::DATE AS day, user_id FROM events), s AS (SELECT DISTINCT day AS first_day FROM d)
SELECT first_day::VARCHAR AS first_day, count(DISTINCT user_id)::BIGINT AS n_users, true AS within_bound FROM s JOIN d ON day BETWEEN first_day AND first_day + 6 GROUP BY first_day""")
def distinct_users_by_week(spark, sf_dir):
    """Different users of the seven days from each day: exact, and whether the merged sketches of the days are within four
    standard errors of it."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "user_id")
    weeks = e.select(F.col("day").alias("first_day")).distinct().withColumn("last_day", F.date_add("first_day", 6))
    approx = rollup.over_ranges(rollup.distinct_sketches(e, ["day"], "user_id"), weeks, "day", "first_day", "last_day")
    users = e.distinct()
    exact = weeks.withColumn("day", F.explode(F.sequence("first_day", "last_day"))).join(users, "day").groupBy("first_day").agg(F.count_distinct("user_id").alias("n_users"))
    near = F.abs(F.col("n_approx") - F.col("n_users")) <= 4 * 1.04 / 64 * F.col("n_users") + 1
    return exact.join(approx, "first_day").select(F.col("first_day").cast("string").alias("first_day"), "n_users", near.alias("within_bound"))
