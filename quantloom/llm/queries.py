"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audio, bpe, clustering, infilling, near_dedup, packing, prefix_hash, quality_classifier, quality_rules, sharding, substring_dedup, token_store, url_filter
from .audio import UNIT
from .common import SPACE, table

#: Shards over which documents are placed.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def vocabulary() -> str:
    """The place of the public word-level vocabulary; a parameter of every operator that takes one."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit_documents(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.grade_documents(docs, model)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return token_store.read_tokens(spark, path, lists=False)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = audio.parse_media(audio.store_texts(table(spark, sf_dir, "documents")))
    return p.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "samples", "seconds", "bad_checksums", "skipped_bytes", "seek_offsets",
    )


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


_TERM = "(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END) / 2"
_CLASS = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", ".,;:!?''\"()-")


def _only(x: str) -> str:
    return ", ".join(f"length(regexp_replace({x}, '[^{c}]', '', 'g')) k{i}" for i, c in enumerate(_CLASS))


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE '*' END lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines FROM d),
n AS (SELECT *, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(t) n_chars FROM w),
u AS (SELECT rid, lang, n_words, n_chars, unnest(ws) word, generate_subscripts(ws, 1) i FROM n),
g AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o gram FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) k FROM g WHERE gram IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT i + o) n FROM c, range(3) r(o) WHERE k > 1 GROUP BY rid),
counted AS (SELECT lang, word, sum(1e0 / n_words) s, sum(1e0 / n_chars) c FROM u WHERE n_words >= 100 GROUP BY ALL),
whites AS (SELECT lang, sum((n_chars - word_chars) / n_chars) white FROM n WHERE n_words >= 100 GROUP BY lang),
shares AS (SELECT * FROM counted WHERE lang <> '*' UNION ALL SELECT '*', word, sum(s), sum(c) FROM counted GROUP BY word),
split AS (SELECT lang, s, c, length(word) k, {_only("word")} FROM shares),
sums AS (SELECT lang, sum(s) n, sum(c * k0) a0, sum(c * k1) a1, sum(c * k2) a2, sum(c * k3) a3, sum(c * (k - k0 - k1 - k2 - k3)) a4 FROM split GROUP BY lang),
ref AS (SELECT lang, n, a0 / n q0, a1 / n q1, a2 / n q2, a3 / n q3, a4 / n q4, (SELECT sum(white) FROM whites x WHERE x.lang = sums.lang OR sums.lang = '*') / n q5 FROM sums),
top AS (SELECT lang, word, s / n q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(s, 9) DESC, word) r FROM shares) JOIN ref USING (lang) WHERE r <= 256),
chosen AS (SELECT n.*, coalesce(ref.lang, '*') own FROM n LEFT JOIN ref USING (lang)),
bins AS (SELECT u.rid, top.q, count(*) / any_value(u.n_words) p FROM u JOIN chosen USING (rid) JOIN top ON top.lang = own AND top.word = u.word WHERE u.n_words >= 100 GROUP BY u.rid, top.word, top.q),
found AS (SELECT rid, sum({_TERM.format(p="p", q="q")}) d, sum(p) p, sum(q) q FROM bins GROUP BY rid),
whole AS (SELECT lang own, sum(q) all_q FROM top GROUP BY lang),
words AS (SELECT rid, n_words, coalesce(d, 0) + (all_q - coalesce(q, 0)) / 2 d, 1 - coalesce(p, 0) po, greatest(1 - all_q, 0) qo FROM chosen JOIN whole USING (own) LEFT JOIN found USING (rid) WHERE n_words >= 100),
word AS (SELECT rid, round(sqrt(greatest(d + {_TERM.format(p="po", q="qo")} - 20e0 / n_words, 0)), 6) word_distance FROM words),
part AS (SELECT rid, own, n_chars, word_chars, {_only("t")} FROM chosen WHERE n_chars >= 200),
class AS (SELECT rid, unnest([k0 / n_chars, k1 / n_chars, k2 / n_chars, k3 / n_chars, (word_chars - k0 - k1 - k2 - k3) / n_chars, (n_chars - word_chars) / n_chars]) p, unnest([q0, q1, q2, q3, q4, q5]) q FROM part JOIN ref ON ref.lang = own),
kind AS (SELECT rid, round(sqrt(greatest(sum({_TERM.format(p="p", q="q")}), 0)), 6) class_distance FROM class GROUP BY rid),
every AS (SELECT doc_id, n_words, word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, class_distance, word_distance
          FROM n LEFT JOIN covered USING (rid) LEFT JOIN kind USING (rid) LEFT JOIN word USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, class_distance, word_distance,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_distance, 0) <= {quality_rules.MOST_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {quality_rules.MOST_WORD_DISTANCE} kept
FROM every
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", " "))
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM w WHERE len(ws) >= 50) s),
first AS (SELECT g, min(doc_id) d FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + o i FROM g JOIN first USING (g), range(50) r(o) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op9_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign_shards(docs, ["doc_id"], SHARDS)


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id r FROM w UNION SELECT reach.doc_id, b FROM reach JOIN ways ON a = r)
SELECT doc_id, coalesce(any_value(n), 0) n_shingles, min(r) component_id, min(r) = doc_id kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op11_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = clustering.with_inertia(clustering.cluster_vectors(table(spark, sf_dir, "embeddings")))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return assigned.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op11_sql(clusters: int = clustering.CLUSTERS, rounds: int = clustering.ROUNDS) -> str:
    near = """a{r} AS (SELECT rid, k, d FROM (SELECT rid, k, d, row_number() OVER (PARTITION BY rid ORDER BY d, k) p FROM (SELECT rid, k, sum((x - c) * (x - c)) d FROM v JOIN c{r} USING (i) GROUP BY rid, k) s) t WHERE p = 1)"""
    move = """c{n} AS (SELECT c.k, c.i, CASE WHEN s IS NULL THEN c ELSE CAST((s - ((s % m) + m) % m) // m AS BIGINT) END c FROM c{r} c LEFT JOIN (SELECT k, i, sum(x) s, count(*) m FROM a{r} JOIN v USING (rid) GROUP BY k, i) s USING (k, i))"""
    parts = [f"""WITH kept AS (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
    v AS (SELECT rid, unnest(e) x, generate_subscripts(e, 1) i FROM kept),
    c0 AS (SELECT k, unnest(e) c, generate_subscripts(e, 1) i FROM (SELECT e, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 k FROM kept) s WHERE k < {clusters})"""]
    for r in range(rounds):
        parts += [near.format(r=r), move.format(n=r + 1, r=r)]
    parts += [near.format(r=rounds), f"names AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) g FROM c{rounds} GROUP BY k)"]
    return ", ".join(parts).replace(" AS (", " AS MATERIALIZED (") + f""" SELECT vec_id, CAST(k AS INTEGER) "cluster", CAST(d AS BIGINT) distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) cluster_inertia, CAST(sum(d) OVER () AS BIGINT) inertia, g centroid_sha256
        FROM kept JOIN a{rounds} USING (rid) JOIN names USING (k)"""


OP11_SQL = _op11_sql()


def op12_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_hash.fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", F.round("near_edited", 9).alias("near_edited"), F.round("near_next", 9).alias("near_next"))


def _prefix_sql(a: str, b: str) -> str:
    """The number of equal items at the beginning of two lists."""
    least = f"least(len({a}), len({b}))"
    return f"coalesce(list_position(list_transform(generate_series(1, {least}), lambda i: {a}[i] <> {b}[i]), true) - 1, {least})"


_POLYNOMIAL = ", ".join(f"list_reduce(list_prepend(0::BIGINT, list_reverse(list_transform({{c}}, lambda x: ord(x)::BIGINT + 1))), lambda h, x: (h * {b} + x) % {p}) {{h}}{m}" for m, (b, p) in enumerate(zip(prefix_hash.BASES, prefix_hash.PRIMES)))
_PRINT = "printf('%x-%08x%08x', len({c}), {h}0, {h}1)"
_LIKE = "CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1e0 ELSE round(({p} + least({s}, least(len({a}), len({b})) - {p})) / greatest(len({a}), len({b})), 9) END"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') t FROM documents),
n AS (SELECT doc_id, t, regexp_extract_all(t, '(?s).') c, coalesce(lead(t) OVER o, first_value(t) OVER o) u FROM t WINDOW o AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, regexp_extract_all(u, '(?s).') d, list_concat(c[:len(c) - len(c) // 2], regexp_extract_all(u, '(?s).')[:len(c) // 2]) e FROM n),
r AS (SELECT *, list_reverse(c) rc, list_reverse(d) rd, list_reverse(e) re FROM e),
l AS (SELECT *, {_prefix_sql("c", "e")} pe, {_prefix_sql("rc", "re")} se, {_prefix_sql("c", "d")} pn, {_prefix_sql("rc", "rd")} sn, {_POLYNOMIAL.format(c="c", h="f")}, {_POLYNOMIAL.format(c="e", h="g")} FROM r)
SELECT doc_id, len(c) n_chars, sha256(array_to_string(e, '')) edited_sha256, {_PRINT.format(c="c", h="f")} fingerprint, {_PRINT.format(c="e", h="g")} edited_fingerprint,
       {_LIKE.format(a="c", b="e", p="pe", s="se")} near_edited, {_LIKE.format(a="c", b="d", p="pn", s="sn")} near_next FROM l
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infilling.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infilling.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_DRAW = "CAST('0x' || substr(h, {k}, 8) AS BIGINT)"
OP13_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') ws, {", ".join(f"{_DRAW.format(k=8 * k + 1)} h{k + 1}" for k in range(4))} FROM t),
c AS (SELECT *, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) a, greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM w),
s AS (SELECT doc_id, t, len(ws) n, form, array_to_string(ws[:a], '') p, array_to_string(ws[a + 1:b], '') m, array_to_string(ws[b + 1:], '') s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256, sha256(t) restored_sha256 FROM s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_url_rules": op2_url_rules,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_token_store": op4_token_store,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_divergence": op6_divergence,
    "op7_packing": op7_packing,
    "op8_fm_index": op8_fm_index,
    "op9_shard_lookup": op9_shard_lookup,
    "op10_bottom_k": op10_bottom_k,
    "op11_block_norms": op11_block_norms,
    "op12_prefix_hashes": op12_prefix_hashes,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {"op2_url_rules": OP2_SQL, "op6_divergence": OP6_SQL, "op8_fm_index": OP8_SQL, "op10_bottom_k": OP10_SQL, "op11_block_norms": OP11_SQL, "op12_prefix_hashes": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
