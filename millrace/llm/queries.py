"""The registered query of each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, license_scan, line_dedup, media, mixing, packing, pii, quality, tiff, toxicity
from millrace.llm.url_filter import judge_urls
from millrace.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def _op10_sql() -> str:
    r"""The kinds in DuckDB: parts and matches of a pattern alternate, so positions are sums of their lengths."""
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(c AS INT) END)) % 10 = 0"
    turned = "string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')"
    mod97 = f"list_reduce(list_transform({turned}, lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END, 0) = 1"
    patterns = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", f"regexp_full_match(m, '{byte}(?:\\.{byte}){{3}}')"),
        "card": ("[0-9](?:[\\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END"),
        "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (pii._IBAN, mod97),
        "secret": (pii._SECRET, "regexp_matches(m, '[0-9]')"),
    }
    found = []
    for at, (kind, _, _, _, score, context) in enumerate(pii.KINDS):
        pattern, valid = patterns[kind]
        near = f"lower(right(pre, {pii.CONTEXT}) || ' ' || left(post, {pii.CONTEXT}))"
        points = f"least(1.0, {score} + (CASE WHEN regexp_matches({near}, '{context}') THEN 0.1::DOUBLE ELSE 0.0 END - CASE WHEN regexp_matches({near}, '{pii.DOUBT}') THEN 0.3::DOUBLE ELSE 0.0 END))"
        own = "" if kind in pii.BASE else f" AND {points} >= {pii.MIN_SCORE}"
        found.append(
            f"SELECT r, {at} AS ord, '{kind}' AS kind, start, start + length(m) AS stop, {points} AS score FROM (SELECT r, ms[i] AS m, parts[i] AS pre, parts[i + 1] AS post, "
            f"list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start "
            f"FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS parts FROM d WHERE regexp_matches(t, '{pattern}')), unnest(range(1, len(ms) + 1)) AS u(i)) WHERE {valid}{own}"
        )
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)
    text = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY ord, start)"
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(found) + ") "
        f"SELECT doc_id, {counts}, sha256(coalesce({text} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce({text}, '') AS spans, round(CAST(max(score) AS DOUBLE), 6) AS max_score FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"
    )


def _op2_sql() -> str:
    templates = ", ".join(f"({t}, '{label}', [{', '.join(repr(k) for k in keys)}])" for t, (label, _, keys) in enumerate(license_scan.TEMPLATES))
    postings = ", ".join(f"({t}, {p}, '{w}')" for w, ps in license_scan._postings().items() for t, p in ps)
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_scan.PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
template(t, label, keys) AS (VALUES {templates}), post(t, p, w) AS (VALUES {postings}), phrase(ws, label) AS (VALUES {phrases}),
token AS (SELECT r, i - 1 AS i, words[i] AS w FROM d, unnest(range(1, len(words) + 1)) AS u(i)),
base AS (SELECT r, i, label FROM token JOIN d USING (r) JOIN phrase ON w = ws[1] AND words[i + 1:i + len(ws)] = ws),
bases AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r),
df AS (SELECT w, count(DISTINCT r) AS n FROM token SEMI JOIN post USING (w) GROUP BY w),
rare AS (SELECT t, w FROM (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) AS k FROM (SELECT DISTINCT t, w FROM post) LEFT JOIN df USING (w)) WHERE k <= {license_scan.RARE}),
own AS (SELECT t, p, w FROM post JOIN rare USING (t, w)),
asked AS (SELECT t, count(*) AS n FROM own GROUP BY t),
votes AS (SELECT r, t, i - p AS start, count(*) AS n FROM token JOIN own USING (w) GROUP BY ALL),
best AS (SELECT r, t, max(n) AS n FROM votes GROUP BY r, t),
match AS (SELECT r, label, CAST(best.n AS DOUBLE) / asked.n AS share FROM best JOIN asked USING (t) JOIN template USING (t) JOIN d USING (r)
          WHERE CAST(best.n AS DOUBLE) / asked.n >= {license_scan.MIN_SHARE} AND len(list_filter(keys, lambda k: contains(' ' || array_to_string(words, ' ') || ' ', ' ' || k || ' '))) = len(keys)),
matches AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels FROM match GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(bases.n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(bases.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(matches.labels, [])))), ','), '') AS labels,
       CAST(greatest(coalesce(share, 0.0), CASE WHEN bases.n > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN matches USING (r)
"""


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('h' || source, '') AS host FROM documents),
v AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS x FROM v, unnest(range(1, len(words) - 6)) AS u(i)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, sum(least(8, coalesce(after - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM repeated) GROUP BY r),
norm AS (SELECT r, host, string_split(regexp_replace(regexp_replace(lower(t), '[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)) AS xs FROM d),
each AS (SELECT r, host, i, trim(x, ' ') AS x FROM (SELECT r, host, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM norm)),
hashed AS (SELECT r, host, i, CAST(('0x' || substr(md5(x), 1, 15)) AS BIGINT) AS h, length(x) - length(replace(x, ' ', '')) + 1 AS w FROM each WHERE x <> ''),
doc AS (SELECT r, any_value(host) AS host, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS doc FROM hashed GROUP BY r),
hosts AS (SELECT host, count(DISTINCT doc) AS all_docs FROM doc GROUP BY host),
often AS (SELECT host, h FROM (SELECT hashed.host, h, count(DISTINCT doc) AS docs FROM hashed JOIN doc USING (r) GROUP BY hashed.host, h) JOIN hosts USING (host)
          WHERE docs > {max_docs} OR (docs >= {min_shared} AND docs > {max_share}::DOUBLE * all_docs)),
lost AS (SELECT r, sum(w) AS n FROM hashed SEMI JOIN often USING (host, h) GROUP BY r),
base AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words FROM v LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words <= 0.7 * n_words AS kept, lost_words FROM base
""".replace("{max_docs}", str(quality.MAX_DOCS)).replace("{min_shared}", str(quality.MIN_SHARED)).replace("{max_share}", str(quality.MAX_SHARE))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.mark(table(spark, sf_dir, "documents"))
    kept = (F.size("gone") == 0) | F.col("left").rlike("[^\\x20\\x09-\\x0D]")
    return df.select("row.doc_id", F.size("gone").cast("long").alias("n_removed_lines"), F.length("left").cast("long").alias("chars_left"), F.sha2(F.col("left").cast("binary"), 256).alias("left_sha256"), kept.alias("kept"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents),
each AS (SELECT r, doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM d),
part AS (SELECT *, count(*) FILTER (WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')) OVER (PARTITION BY r ORDER BY i) - 1 AS p FROM each),
filled AS (SELECT r, doc_id, x, p, CAST(('0x' || substr(md5(x), 1, 15)) AS BIGINT) % {prime} AS h, len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words
           FROM part WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
rolled AS (SELECT *, coalesce((h + lag(h) OVER w * {factor}) % {prime} % {spacing} = 0, false) AS zero, lead(x) OVER w AS after FROM filled WINDOW w AS (PARTITION BY r ORDER BY p)),
ended AS (SELECT *, zero AND NOT coalesce(lag(zero) OVER w, false) AS last FROM rolled WINDOW w AS (PARTITION BY r ORDER BY p)),
numbered AS (SELECT *, coalesce(sum(CASE WHEN last THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ended),
chunk AS (SELECT 1 AS kind, r, doc_id, min(p) AS first, count(*) AS size, string_agg(x, chr(10) ORDER BY p) AS content FROM numbered GROUP BY r, doc_id, c HAVING count(*) > 1
          UNION ALL SELECT 2, r, doc_id, p, 2, x || chr(10) || after FROM rolled WHERE after IS NOT NULL
          UNION ALL SELECT 3, r, doc_id, p, 1, x FROM filled WHERE words >= {long}),
more AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, content ORDER BY doc_id NULLS LAST, r, first) AS k FROM chunk) WHERE k > 1),
island AS (SELECT r, first, first - row_number() OVER (PARTITION BY r ORDER BY first) AS g FROM more WHERE kind = 2),
stretch AS (SELECT r, min(first) AS a, max(first) + 1 AS z FROM island GROUP BY r, g),
long AS (SELECT stretch.r, a, z FROM stretch JOIN filled ON filled.r = stretch.r AND p BETWEEN a AND z GROUP BY ALL HAVING sum(words) >= {long}),
gone AS (SELECT r, unnest(range(first, first + size)) AS p FROM more WHERE kind IN (1, 3) UNION SELECT r, unnest(range(a, z + 1)) FROM long),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
rest AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS t FROM part ANTI JOIN gone USING (r, p) GROUP BY r),
res AS (SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN text ELSE coalesce(t, '') END AS t FROM d LEFT JOIN n USING (r) LEFT JOIN rest USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_removed_lines, CAST(length(t) AS BIGINT) AS chars_left, sha256(t) AS left_sha256, n = 0 OR regexp_matches(t, '[^\\x20\\x09-\\x0D]') AS kept FROM res
""".replace("{prime}", str(line_dedup._PRIME)).replace("{factor}", str(line_dedup._FACTOR)).replace("{spacing}", str(line_dedup.SPACING)).replace("{long}", str(line_dedup.LONG))


def op4_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum in its order; positions are rounded to thousandths of a word."""
    df = mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    places = [F.round(c, 3).alias(c) for c in ("position", "last_position")]
    return df.select("doc_id", "size", "source_size", "target", "taken", "copies", "begins", *places)


OP4_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight, [-0.8, 0.0, 0.8][(place - 1) % 3 + 1]::DOUBLE AS slope, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS rank,
      (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, slope, round(least(cap, coalesce((SELECT arg_min(level, rank) FROM o AS f WHERE f.level * f.weight <= f.cap) * weight, cap)), 6) AS target FROM o),
run AS (SELECT sum(target) AS words, sum(target * slope) AS slopes FROM t),
c AS (SELECT d.*, t.source_size, t.target, t.slope, CAST(round(t.target) AS BIGINT) AS goal,
      CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM c),
m AS (SELECT *, greatest(0, least(size, goal - epochs * source_size - begun)) AS more FROM e),
n AS (SELECT *, CAST(epochs * size + more AS BIGINT) AS taken, CASE WHEN epochs * size + more > 0 THEN epochs + CASE WHEN more > 0 THEN 1 ELSE 0 END ELSE 0 END AS copies FROM m),
x AS (SELECT *, CASE WHEN copies > 0 THEN begun / target END AS first, CASE WHEN copies > 0 THEN ((copies - 1) * source_size + begun) / target END AS last, 1.0::DOUBLE - slope AS b FROM n),
y AS (SELECT *, CASE WHEN slope = 0 THEN first ELSE (sqrt(greatest(0.0, b * b + 4.0 * slope * first)) - b) / (2.0 * slope) END AS t1,
             CASE WHEN slope = 0 THEN last ELSE (sqrt(greatest(0.0, b * b + 4.0 * slope * last)) - b) / (2.0 * slope) END AS t2 FROM x)
SELECT doc_id, size, source_size, target, taken, CAST(copies AS BIGINT) AS copies, CASE WHEN copies > 0 THEN begun END AS begins,
       CASE WHEN copies > 0 THEN round((words - slopes) * t1 + slopes * t1 * t1, 3) END AS position, CASE WHEN copies > 0 THEN round((words - slopes) * t2 + slopes * t2 * t2, 3) END AS last_position FROM y, run
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


#: links of the definition: classes of equal sets, pairs by shared shingles, components by reachable classes
OP6_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
                           ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - {size} + 2), lambda i: array_to_string(ws[i:i + {size} - 1], ' ')))) END AS s FROM d),
class AS (SELECT s, min(r) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingle AS (SELECT c, n, unnest(s) AS x FROM class),
link AS (SELECT a.c AS a, b.c AS b FROM shingle a JOIN shingle b ON a.x = b.x AND a.c <> b.c AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
         GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT c, c FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
rooted AS (SELECT sets.doc_id, len(sets.s) AS n, root FROM sets LEFT JOIN class USING (s) LEFT JOIN root USING (c)),
least AS (SELECT root, min(doc_id) AS component_id FROM rooted WHERE root IS NOT NULL GROUP BY root)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE component_id END AS component_id FROM rooted LEFT JOIN least USING (root)
""".replace("{size}", str(jaccard_join.SHINGLE)).replace("{percent}", str(jaccard_join.PERCENT))


def op7_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_to_media(table(spark, sf_dir, "documents"))


def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as files, and a row per page of each: the reader of ``op8`` by itself."""
    files = media.text_files(table(spark, sf_dir, "documents"))
    return tiff.tiff_pages(files, "file", ["doc_id"]).withColumn("pixels_sha256", F.sha2("pixels", 256)).drop("pixels")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = pii.find_pii(docs).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return df.select("doc_id", *map(count, pii.BASE), F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 6).alias("max_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix_curriculum": op4_mix_curriculum,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_pack_binary": op7_pack_binary,
    "op8_tiff_media": op8_tiff_media,
    "tiff_pages": tiff_pages,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": _op2_sql(), "op10_pii": _op10_sql(), "op1_quality_rules": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_mix_curriculum": OP4_SQL, "op6_ngram_jaccard": OP6_SQL}
