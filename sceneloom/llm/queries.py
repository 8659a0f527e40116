"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, html_text, merkle, mixing, near_join, quality, quality_rules, sharding, suffix_dedup, token_counts, vector_codes, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_digest(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, count(*) OVER (PARTITION BY payload_digest) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

SQL_OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i : i + 399]) AS m FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
k AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM k),
s AS (SELECT r, n, min(i) AS a, max(i) + 400 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM g) GROUP BY r, n),
p AS (SELECT r, z AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a) - 1, -1) AS z, a AS o FROM s
    UNION ALL SELECT r, 1, min(a) - 1, 0 FROM s GROUP BY r),
t AS (SELECT p.r, string_agg(CASE WHEN p.z = -1 THEN hex(b[p.a : octet_length(b)]) WHEN p.z < p.a THEN '' ELSE hex(b[p.a : p.z]) END, '' ORDER BY p.o) AS kept
    FROM p JOIN d USING (r) GROUP BY p.r),
c AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
h AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, win)),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""

SQL_OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (rank - 1) % 3 AS weight FROM s),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, rank) AS k, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM o),
v AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, round(least(cap, weight * coalesce((SELECT lev FROM v), cap / weight)), 6) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS reach
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN reach <= rest AND target > 0 THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM c
"""

SQL_OP5 = """
WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""


def _draw(name: str) -> str:
    return f"(('0x' || substr(md5('{name}/' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / {16**13}.0::DOUBLE"


def _place(node: sharding.Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _place(node.children[0])
    costs = ", ".join(f"-ln({_draw(c.name)}) / {c.total}" for c in node.children)
    return f"CASE list_position([{costs}], list_min([{costs}])) " + " ".join(f"WHEN {i} THEN {_place(c)}" for i, c in enumerate(node.children, 1)) + " END"


_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""
SQL_OP7 = f"""
WITH {_CRC},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM documents, crc),
p AS (SELECT doc_id, size, text_crc32, md5(k) AS h, {_place(sharding.tree(8))} AS shard, {_place(sharding.grow(sharding.tree(8), 8))} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM p
"""



def _hashed(n_chars: str) -> str:
    each = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in each) + ")"


def _levels(name: str, first: str, key: str) -> str:
    """All levels of the trees over (key, i, h, n)."""
    return f"""{name}({key}, level, i, h, n) AS ({first} UNION ALL
    SELECT {key}, level + 1, i // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (PARTITION BY {key} ORDER BY i) AS after FROM {name} WHERE n > 1) WHERE i % 2 = 0)"""


def _steps(tree: str, rows: str, key: str, at: int) -> str:
    """What each row's node meets on each level below the root: L or R and the sibling's digest, N without one."""
    return f"""SELECT w.r, {at} + b.level AS k, CASE WHEN s.h IS NULL THEN 'N' WHEN (w.i >> b.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS step
    FROM {rows} w JOIN (SELECT DISTINCT {key}, level FROM {tree} WHERE n > 1) b ON w.{key} IS NOT DISTINCT FROM b.{key}
    LEFT JOIN {tree} s ON s.{key} IS NOT DISTINCT FROM b.{key} AND s.level = b.level AND s.i = xor(w.i >> b.level, 1)"""


SQL_OP11 = f"""
WITH RECURSIVE {_CRC},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {_hashed('n_chars')} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 7 = 0 THEN {_hashed('n_chars::HUGEINT + 1')} END AS tampered FROM documents, crc),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_levels('t', 'SELECT lang, 0, i, leaf, n FROM o', 'lang')},
g AS MATERIALIZED (SELECT lang, h, 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels('u', 'SELECT one, 0, i, h, n FROM g', 'one')},
w AS MATERIALIZED (SELECT o.r, g.i, g.one, g.h FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang),
s AS ({_steps('t', 'o', 'lang', 0)} UNION ALL {_steps('u', 'w', 'one', 1000)}),
p AS (SELECT r, list(step ORDER BY k) AS steps FROM s GROUP BY r),
f AS (SELECT o.doc_id, o.leaf, w.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(p.steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
    list_reduce([coalesce(o.tampered, o.leaf)] || coalesce(p.steps, []), lambda h, x: sha256(CASE x[1] WHEN 'N' THEN h WHEN 'L' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root
    FROM o JOIN w USING (r) LEFT JOIN p USING (r))
SELECT *, folded_root = root AS verified FROM f
"""


def _lloyd(n: int) -> str:
    """Assignments of round n to the entries before, and the entries after it."""
    return f"""
a{n} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT r, p, e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d
    FROM x JOIN c{n - 1} c USING (p)) GROUP BY r, p),
s{n} AS (SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT p, best.e AS e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS v FROM x JOIN a{n} USING (r, p)) GROUP BY p, e, i),
c{n} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{n - 1} c
    LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY p, e) m USING (p, e)),"""


SQL_OP12 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 AND len(embedding) % 16 = 0),
v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r FROM k
    WHERE len(q) = (SELECT len(q) FROM k ORDER BY vec_id NULLS LAST, len(q) LIMIT 1)),
x AS MATERIALIZED (SELECT r, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS v FROM v, range(16) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64),{_lloyd(1)}{_lloyd(2)}{_lloyd(3)}
t AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a3 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN t USING (r), h
"""

QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_near_join": op8_near_join,
    "op9_token_counts": op9_token_counts,
    "op10_html_text": op10_html_text,
    "op11_merkle": op11_merkle,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES = {"op1_warc": SQL_OP1, "op2_suffix_dedup": SQL_OP2, "op3_decontamination": SQL_OP3, "op4_mixing": SQL_OP4, "op5_exact_dedup": SQL_OP5, "op7_sharding": SQL_OP7, "op11_merkle": SQL_OP11, "op12_vector_codes": SQL_OP12}
