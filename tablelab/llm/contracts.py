"""One query for each operator, with the parameters of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.llm.boilerplate import drop_site_lines, host_of, text_of
from tablelab.llm.decontamination import decontaminate
from tablelab.llm.exact_dedup import exact_dedup
from tablelab.llm.hyperplane_tree import hard_negatives
from tablelab.llm.log_bilinear import score_texts
from tablelab.llm.minmax import near_duplicates
from tablelab.llm.mixing import mix
from tablelab.llm.pii import KINDS, find_pii, fit_pii
from tablelab.llm.queries import query
from tablelab.llm.ranking import quality
from tablelab.llm.sampling import fold_of
from tablelab.llm.toxicity import fit_toxicity, score_toxicity
from tablelab.llm.units import repeated_spans
from tablelab.llm.url_lists import active_entries, host, path
from tablelab.llm.vector_codes import ENTRIES, PARTS, ROUNDS, books_digest, vector_codes, with_label_error


@query("op1_toxicity")
def _(table):
    docs, labels = table("documents"), table("labels").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels, training=fold_of(F.col("id"), 3) != 1)
    scored = score_toxicity(docs, model, ["doc_id"])
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["p"], s["start"], s["end"])))
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))


EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""


@query("op2_exact_dedup", EXACT_DEDUP_SQL)
def _(table):
    return exact_dedup(table("documents"))


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(list_slice(w, s, s + 9), ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT length FROM windows),
places AS (
  SELECT doc_id, s, length, array_to_string(list_slice(w, s, s + length - 1), ' ') AS key
  FROM (SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS s FROM d, lengths)),
hits AS (SELECT p.doc_id, p.s, p.length, x.item_id FROM places p JOIN windows x USING (key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + length)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def _(table):
    return decontaminate(table("documents").select("doc_id", "text"), table("benchmark"))


@query("op5_tagged_pii")
def _(table):
    docs = table("documents")
    found = find_pii(docs, fit_pii(docs), ["doc_id"])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(place(s).alias("k"), s["start"], s["end"], s["kind"]))), name)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform("base", name), ","), 256).alias("base_sha256"), F.array_join(ordered, ",").alias("spans"))


@query("op3_soft_mixing")
def _(table):
    docs = table("documents")
    quality_of = table("labels").filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = docs.select("doc_id", "lang").join(quality_of, "doc_id").select("doc_id", F.concat_ws("_", "lang", "quality").alias("domain"))
    return mix(docs, labelled).select(F.col("id").alias("doc_id"), "n_tokens", "domain", "rate", "copies", "gap")


@query("op9_repeated_units")
def _(table):
    return repeated_spans(table("documents")).select(
        F.col("id").alias("doc_id"), F.col("first_id").alias("first_doc_id"), "start", "end", F.col("words").cast("long").alias("n_words"))


URL_LISTS_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
         string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), '/') AS raw,
         DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INT) AS fetched, DATE '2024-01-01' + CAST((page_id * 104729) % 366 AS INT) AS dated,
         length(html) % 2 = 0 AS listed, length(url) AS len
  FROM pages),
q AS (SELECT *, list_filter(raw, lambda x: x <> '') AS parts, string_split(host, '.') AS labels FROM p),
history AS (
  SELECT CASE len % 3 WHEN 0 THEN host WHEN 1 THEN host || '/' || parts[1] ELSE host || '/' || array_to_string(parts, '/') END AS name, dated AS at, bool_or(listed) AS listed
  FROM q WHERE host <> '' AND len(parts) > 0 GROUP BY 1, 2),
asked AS (
  SELECT page_id, fetched, unnest(list_distinct(list_concat(
           list_transform(range(1, len(labels) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')),
           list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(list_slice(parts, 1, i), '/'))))) AS name
  FROM q WHERE host <> ''),
held AS (
  SELECT a.page_id, a.name FROM asked a JOIN history h ON h.name = a.name AND h.at <= a.fetched
  QUALIFY row_number() OVER (PARTITION BY a.page_id, a.name ORDER BY h.at DESC) = 1 AND h.listed),
found AS (SELECT page_id, count(*) AS n, first(name ORDER BY length(name) DESC, name) AS entry FROM held GROUP BY page_id)
SELECT p.page_id, p.fetched AS fetched_at, found.n IS NOT NULL AS blocked, coalesce(found.n, 0) AS n_active, found.entry
FROM p LEFT JOIN found USING (page_id)"""


@query("op7_dated_url_lists", URL_LISTS_SQL)
def _(table):
    pages = table("pages")
    day = lambda factor: F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * factor) % 366).cast("int"))
    parts = F.filter(F.split(path(F.col("url")), "/"), lambda p: p != "")
    # The list: each page dates an entry for its host, for a first part of the path or for the whole path.
    entries = pages.select(
        host(F.col("url")).alias("host"), parts.alias("parts"), day(104729).alias("at"), (F.char_length("html") % 2 == 0).alias("listed"),
        (F.char_length("url") % 3).alias("kind")).filter((F.col("host") != "") & (F.size("parts") > 0))
    name = F.when(F.col("kind") == 0, F.col("host")).when(F.col("kind") == 1, F.concat_ws("/", "host", F.get("parts", F.lit(0)))).otherwise(
        F.concat_ws("/", "host", F.array_join("parts", "/")))
    captures = pages.select("page_id", "url", day(7919).alias("fetched_at"))
    return active_entries(captures, entries.select(name.alias("name"), "at", "listed"), at="fetched_at").drop("url")


@query("op8_pairwise_quality")
def _(table):
    scored = quality(table("documents"), table("labels").select("doc_id", "quality"), training=fold_of(F.col("id"), 5) != 0)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r),
roots AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(roots.r, w.doc_id) AS component_id, w.doc_id = coalesce(roots.r, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN roots USING (doc_id)"""


@query("op6_minmax_near_duplicates", NEAR_DUPLICATES_SQL)
def _(table):
    return near_duplicates(table("documents"), shingle=3, percent=85)


LINES_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS site,
         string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)) AS l
  FROM pages),
u AS (SELECT page_id, site, k, l[k] AS line, trim(regexp_replace(l[k], '[\x09-\x0D\x20]+', ' ', 'g')) AS norm
      FROM (SELECT page_id, site, l, unnest(range(1, len(l) + 1)) AS k FROM p)),
totals AS (SELECT site, count(*) AS pages FROM p GROUP BY site),
common AS (SELECT site, norm FROM (SELECT site, norm, count(DISTINCT page_id) AS n FROM u WHERE norm <> '' GROUP BY 1, 2) JOIN totals USING (site)
           WHERE n > pages * 0.1::DOUBLE AND n >= 3)
SELECT u.page_id, u.site, sum((u.norm <> '')::INT)::BIGINT AS n_lines, sum((c.norm IS NOT NULL)::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(u.line, chr(10) ORDER BY u.k) FILTER (c.norm IS NULL), '')) AS text_sha256
FROM u LEFT JOIN common c ON c.site = u.site AND c.norm = u.norm GROUP BY u.page_id, u.site"""


@query("op10_site_lines", LINES_SQL)
def _(table):
    pages = table("pages").select("page_id", "url", text_of(F.col("html")).alias("text"))
    clean = drop_site_lines(pages, host_of(F.col("url")), "text")
    return clean.select("page_id", "site", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


_SOUND_SQL = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after the other; a distance and an entry's index are one number, so that its minimum has the lower index."""
    width = f"(len(v) // {parts})"
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings WHERE {_SOUND_SQL}),
p AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(v, part * {width} + 1, (part + 1) * {width}) AS x FROM (SELECT *, unnest(range({parts})) AS part FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, x AS e FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS entry FROM p) WHERE entry < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p.part, x, min((list_dot_product(x, x) - 2 * list_dot_product(x, e) + list_dot_product(e, e))::BIGINT * {entries} + entry) AS m
  FROM p JOIN b{r} ON p.part = b{r}.part GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT part, entry, list(v ORDER BY j) AS e FROM (
  SELECT part, m % {entries} AS entry, j, floor(sum(c) / count(*)) AS v FROM (SELECT part, m, unnest(x) AS c, unnest(range(len(x))) AS j FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.e, b.e) AS e FROM b{r} b LEFT JOIN s{r} s USING (part, entry))""")
    return ",".join(steps) + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY ALL),
books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS d FROM (SELECT part, entry, unnest(e) AS c, unnest(range(len(e))) AS j FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM coded, books"""


@query("op11_vector_codes", vector_codes_sql())
def _(table):
    coded, books = vector_codes(table("embeddings"))
    return with_label_error(coded).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


HARD_NEGATIVES_SQL = f"""
WITH k AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_SOUND_SQL}),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
  FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (
  SELECT p.a, p.b, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, b AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5"""


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def _(table):
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table("embeddings").withColumn("label", changed), F.col("id") % 100 == 0)


@query("op13_log_bilinear_scores")
def _(table):
    scored = score_texts(table("documents"), training=fold_of(F.col("id"), 7) != 2)
    return scored.select(
        F.col("id").alias("doc_id"), (fold_of(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
