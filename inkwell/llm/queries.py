"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.bpe import digests
from inkwell.llm.centroids import clusters
from inkwell.llm.collocations import collocations
from inkwell.llm.common import table
from inkwell.llm.exact_dedup import exact_groups
from inkwell.llm.langid import held_out, identified, train
from inkwell.llm.licenses import scanned
from inkwell.llm.linededup import line_digests
from inkwell.llm.lm import scored
from inkwell.llm.neardup import classes
from inkwell.llm.packing import packed
from inkwell.llm.pii import personal_data
from inkwell.llm.topk import top_k
from inkwell.llm.warc import round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), uri_col="url")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "rejected")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_bpe": op2_bpe,
        "op3_neardup": op3_neardup,
        "op4_pii": op4_pii,
        "op5_licenses": op5_licenses,
        "op6_warc": op6_warc,
        "op7_packing": op7_packing,
        "op8_topk": op8_topk,
        "op9_lm": op9_lm,
        "op10_langid": op10_langid,
        "op11_centroids": op11_centroids,
        "op12_linededup": op12_linededup,
        "op13_collocations": op13_collocations,
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lloyd(rounds: int) -> str:
    """Rounds over all vectors, one after another: v (vec_id, q), then for each round the assignments a and the centroids c."""
    near = """
        SELECT row, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (
            SELECT row, c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{n} AS k
        ) GROUP BY row
    """
    steps = [
        """
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, row) - 1 AS c, q FROM (SELECT *, sha256('1:' || vec_id) AS h FROM v ORDER BY h, row LIMIT 16))
        """
    ]
    for n in range(rounds):
        steps.append(f"""
        a{n} AS MATERIALIZED ({near.format(n=n)}),
        m{n} AS (SELECT c, place, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.q) AS x, unnest(range(64)) AS place FROM v JOIN a{n} AS a USING (row)) GROUP BY ALL),
        f{n} AS (SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY place) AS q FROM m{n} GROUP BY c),
        c{n + 1} AS MATERIALIZED (SELECT c, coalesce(f.q, k.q) AS q FROM c{n} AS k LEFT JOIN f{n} AS f USING (c))
        """)
    return f"WITH {', '.join(steps)}, last AS MATERIALIZED ({near.format(n=rounds)})"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_centroids": _lloyd(3) + """
            SELECT v.vec_id, l.c::INTEGER AS cluster, l.d::BIGINT AS distance, (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia,
                   (sum(l.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
            FROM v JOIN last AS l USING (row) JOIN c3 AS k ON k.c = l.c
        """,
        "op12_linededup": f"""
            WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
            e AS (SELECT row, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
            k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key FROM e),
            n AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
            o AS (SELECT k.*, n.key IS NOT NULL AS gone FROM k LEFT JOIN n USING (key))
            SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
            FROM o GROUP BY row
        """,
        "op13_collocations": f"""
            WITH p AS (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
            ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
            g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
            s AS (SELECT lang, unnest([w[i:i], w[i:i+1], w[i:i+2]]) AS g, unnest([1, 2, 3]) AS size, len(w) - i + 1 AS room FROM g),
            f AS MATERIALIZED (SELECT lang, g, size, count(*) AS f FROM s WHERE size <= room GROUP BY ALL),
            n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
            c AS MATERIALIZED (SELECT lang, g, size, f AS a FROM f WHERE size > 1 AND f >= 10),
            k AS (SELECT lang, g, size, a, unnest(range(1, size)) AS k FROM c),
            x AS (
                SELECT k.lang, k.g, k.size, k.a, k.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f)) AS score
                FROM k JOIN f AS l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN f AS r ON r.lang = k.lang AND r.g = k.g[k.k + 1:]
            ), m AS (SELECT lang, g, size, a, arg_min({{'l': l, 'r': r, 'score': score}}, {{'s': score, 'k': k}}) AS b FROM x GROUP BY ALL),
            i AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE size = 3),
            o AS (SELECT lang, g, max(a) AS more FROM i GROUP BY ALL),
            z AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, m.a, b.l AS l, b.r AS r, b.score AS score FROM m LEFT JOIN o ON o.lang = m.lang AND o.g = m.g WHERE o.more IS NULL OR 100 * o.more < 50 * m.a),
            q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
            SELECT q.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= 2000
        """,
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)
        """,
        "op8_topk": """
            WITH e AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v::DOUBLE[], e.v::DOUBLE[])::BIGINT AS score
                FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0
            ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
        """,
    }
