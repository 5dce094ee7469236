"""One query per operator over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.llm import decontamination, lexical_search, license_scan, line_dedup, lm_scoring, main_text, minhash_dedup, mixing, paragraph_dedup, pii, quality_lm, spelling_variants, vector_search
from filmloom.llm.tables import ORACLES, QUERIES, query, table  # noqa: F401


@query("op5_minhash_near_dedup")
def op5(spark, sf):
    return minhash_dedup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op3_benchmark_decontamination")
def op3(spark, sf):
    found = decontamination.contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op9_source_mixing")
def op9(spark, sf):
    drawn = mixing.draws(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return drawn.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["words"]).alias("taken"), F.size("draws").alias("n_draws"),
    )


@query("op10_line_dedup", """
WITH line AS (SELECT doc_id, row_number() OVER () AS line_no, pos, l, lower_key AS key FROM (
    SELECT doc_id, pos, l, trim(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS lower_key
    FROM (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))),
repeated AS (SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, coalesce(l.doc_id < r.last, false) AS gone FROM line l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op10(spark, sf):
    done = line_dedup.with_kept_lines(table(spark, sf, "documents").select("doc_id", "text"), "kept", "lines")
    n_lines, n_kept = F.size("lines").cast("bigint"), F.size("kept").cast("bigint")
    return done.select("doc_id", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


@query("op4_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op4(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query("op1_stupid_backoff", """
WITH word AS (SELECT doc_id, pos, w, lag(w, 1) OVER d AS b, lag(w, 2) OVER d AS a FROM (
    SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL))
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
one AS (SELECT w, count(*) AS c FROM word GROUP BY w),
two AS (SELECT b, w, count(*) AS c FROM word WHERE b IS NOT NULL GROUP BY b, w HAVING count(*) >= 2),
three AS (SELECT a, b, w, count(*) AS c FROM word WHERE a IS NOT NULL GROUP BY a, b, w HAVING count(*) >= 2),
scored AS (SELECT x.doc_id, CASE WHEN x.a IS NOT NULL THEN three.c IS NULL WHEN x.b IS NOT NULL THEN two.c IS NULL ELSE false END AS backed,
    CASE WHEN three.c IS NOT NULL THEN ln(three.c / h2.c)
      WHEN two.c IS NOT NULL THEN ln(two.c / h1.c) + CASE WHEN x.a IS NULL THEN 0 ELSE ln(0.4) END
      ELSE ln(one.c / (SELECT count(*) FROM word)) + CASE WHEN x.a IS NOT NULL THEN 2 WHEN x.b IS NOT NULL THEN 1 ELSE 0 END * ln(0.4) END AS s
  FROM word x JOIN one ON one.w = x.w LEFT JOIN two ON two.b = x.b AND two.w = x.w LEFT JOIN three ON three.a = x.a AND three.b = x.b AND three.w = x.w
  LEFT JOIN one h1 ON h1.w = x.b LEFT JOIN two h2 ON h2.b = x.a AND h2.w = x.b)
SELECT d.doc_id, count(s.s) AS n_words, CAST(coalesce(sum(CAST(s.backed AS INTEGER)), 0) AS BIGINT) AS n_backoff, coalesce(round(sum(s.s), 4), 0) AS log_score
FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""")
def op1(spark, sf):
    return lm_scoring.scores(table(spark, sf, "documents").select("doc_id", "text")).withColumn("log_score", F.round("log_score", 4))


@query("op7_quality_perplexity")
def op7(spark, sf):
    judged = quality_lm.classify(table(spark, sf, "documents").select("doc_id", "text", "lang"), table(spark, sf, "labels"))
    return judged.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


@query("op2_disclosure_sanitisation")
def op2(spark, sf):
    found = pii.marked(table(spark, sf, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    def count(i):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{pii.KINDS[i]}")

    counts = [count(i) for i in range(4)]
    removed = F.size(F.filter("spans", lambda s: (s["kind"] == 4) & s["removed"])).cast("bigint")
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base) - removed).alias("n_generalised"), removed.alias("n_removed"), F.sha2("clean", 256).alias("clean_sha256"),
    )


@query("op6_license_scan")
def op6(spark, sf):
    found = license_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_paragraphs", F.array_join("licences", ",").alias("licences"), "unknown")


@query("op8_paragraph_dedup")
def op8(spark, sf):
    found = paragraph_dedup.repeated_passages(table(spark, sf, "documents").select("doc_id", "text"))
    at = F.transform("passages", lambda p: p["at"])
    size = paragraph_dedup.LEAST_WORDS
    covered = F.aggregate(at, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")), lambda s, a: F.struct(
        (s["n"] + a + size - F.greatest(a, s["to"])).alias("n"), (a + size).alias("to")))["n"]
    return found.select(
        "doc_id", "n_words", covered.alias("n_repeated_words"), (covered > 0).alias("repeats"),
        F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["first_doc"]))).alias("first_docs"),
        "n_paragraphs", F.size("removed").cast("bigint").alias("n_removed"), F.transform("removed", lambda r: r["like"]).alias("removed_like"),
    )


@query("op11_spelling_variants", """
WITH RECURSIVE code AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
run AS (SELECT doc_id, r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT r, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), 128 + (unicode(x) & 63)] END))),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h FROM run, code),
word AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 97 <> 0 THEN r
    ELSE substring(r, 1, CAST(h % length(r) AS BIGINT)) || substring(r, CAST(h % length(r) AS BIGINT) + 2) END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -m, 'other': other}) AS top FROM near GROUP BY word),
judged AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 2 * n THEN top.other END AS form,
    CASE WHEN -top.less >= 2 * n THEN -top.less END AS form_n FROM word w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.root AND j.form IS NOT NULL)
SELECT j.word, j.n, j.n_near, j.form, j.form_n, c.root FROM judged j JOIN chain c ON c.word = j.word JOIN judged e ON e.word = c.root AND e.form IS NULL
""")
def op11(spark, sf):
    return spelling_variants.variants(spelling_variants.corpus_words(table(spark, sf, "documents")))


@query("op12_ranked_lexical_search", """
WITH term AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents) GROUP BY ALL),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM term GROUP BY doc_id),
size AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM doc),
item AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM term GROUP BY t), size),
scored AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM item JOIN weight USING (t) JOIN term USING (t) JOIN doc USING (doc_id), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
""")
def op12(spark, sf):
    return lexical_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_main_text")
def op13(spark, sf):
    return main_text.extracted(table(spark, sf, "pages"))


@query("pipeline")
def pipeline(spark, sf):
    # Imported here: the pipeline is built from this folder's operators.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
