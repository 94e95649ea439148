"""One query per operator over its whole table, and the same in SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.functions.arrays import bind
from epistrand.llm import bpe, embeddingdedup, hardnegatives, languages, linededup, minhash, mixing, neighbours, packing, periodic, substrings, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


URL_RULES = (
    urls.Rule("com", "/", urls.ALLOW),
    urls.Rule("example.com", "/en/", urls.BLOCK),
    urls.Rule("www.example.com", "/en/", urls.ALLOW),
    urls.Rule("net", "/es/", urls.BLOCK),
    urls.Rule("net", "/fr/", urls.BLOCK),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, URL_RULES, urls.fit(urls.examples(spark)))
    return judged.select("page.page_id", "host", "path", "rule", "verdict", "block_probability")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(_table(spark, sf_dir, "documents"), with_ids=False)
    return packing.pack(pieces)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddingdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.mix_counts(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rewritten.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hardnegatives.mine(vectors, F.pmod("vec_id", F.lit(100)) == 0)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """In every tenth document by checksum, the words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        first = F.pmod(g, n).cast("int")
        period = (F.floor((n - first) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1).cast("int")
        place = F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.when(i < first, i).otherwise(first + F.pmod(i - first, period))
        )
        changed = F.array_join(F.transform(place, lambda i: F.get(words, i)), " ")
        return F.when(n > 0, changed).otherwise(F.col("text"))

    planted = bind(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), repeat)
    return docs.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Runs come by start and period, so the first of equal exponents stays.
    best = F.aggregate(
        "runs",
        none,
        lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m),
    )
    found = found.select("doc.doc_id", "n_words", "runs", "collapsed", best.alias("best"), listed.alias("listed"))
    thousandths = F.lit(1000) * F.col("best.length")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        ((thousandths - F.pmod(thousandths, F.col("best.period"))) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.with_bytes(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return encoded.select(
        "doc.doc_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.sha2("little_endian", 256).alias("ids_sha256"),
        F.sha2("decode", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_toxicity,
        op3_language_id,
        op4_url_filter,
        op5_best_fit_packing,
        op6_nearest_neighbours,
        op7_embedding_near_dedup,
        op8_source_mixing,
        op9_minhash_near_dedup,
        op10_line_dedup,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

ORACLE = {
    "op8_source_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents
        ), ranked AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                       WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM sizes GROUP BY source
        ), levels AS (
            SELECT s.source, s.weight, s.source_size,
                   (1.5::DOUBLE * (SELECT sum(source_size) FROM ranked)
                    - 2.0::DOUBLE * (SELECT coalesce(sum(o.source_size), 0) FROM ranked o
                                     WHERE 2.0::DOUBLE * o.source_size / o.weight < 2.0::DOUBLE * s.source_size / s.weight))
                   / (SELECT sum(o.weight) FROM ranked o
                      WHERE 2.0::DOUBLE * o.source_size / o.weight >= 2.0::DOUBLE * s.source_size / s.weight) AS level
            FROM ranked s
        ), common AS (
            SELECT min_by(level, 2.0::DOUBLE * source_size / weight) AS level FROM levels
            WHERE level * weight <= 2.0::DOUBLE * source_size
        ), targets AS (
            SELECT source, source_size,
                   coalesce(least((SELECT level FROM common) * weight, 2.0::DOUBLE * source_size),
                            2.0::DOUBLE * source_size) AS target
            FROM ranked
        ), rates AS (
            SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
        ), counted AS (
            SELECT s.doc_id, s.size, r.source_size, r.target,
                   (floor(r.rate) + CASE WHEN
                       ('0x' || substr(md5('mix1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
                       / 4294967296.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
            FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
        )
        SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM counted
    """,
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), numbered AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM lines
        ), keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM numbered
        ), firsts AS (
            SELECT line_key, min(doc_id) AS first_doc FROM keyed
            WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) > 1
        ), judged AS (
            SELECT k.doc_id, k.pos, k.line, f.line_key IS NULL OR k.doc_id = f.first_doc AS stays
            FROM keyed k LEFT JOIN firsts f ON k.line_key = f.line_key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
