"""The operators of this subpackage as registered queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import exact, jaccard, language, mixing, negatives, neighbours, packing, quality, sharding, structure, substrings, toxicity, warc
from tessera.llm.labelled import third
from tessera.llm.shared import id_remainder, table

SHARDS = sharding.uniform_tree(4, 2, 2)


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, lambda c: id_remainder(c, 5) != 0)
    return language.identify(docs, model).select(
        F.col("id").alias("doc_id"), (id_remainder("id", 5) == 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "accepted")


def op2_warc(spark, sf_dir):
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).drop("record")


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def digest(pieces):
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op4_packing(spark, sf_dir):
    return digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 1024))


def op5_jaccard(spark, sf_dir):
    found = jaccard.jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


def scored(rows, least):
    return rows.select(F.col("id").alias("doc_id"), (id_remainder("id", 3) == 1).alias("held_out"), "score",
                       (F.col("score") >= least).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), third(1))), 0.5)


def op7_sharding(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS, sharding.grown_tree(SHARDS))


def op8_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0, k=20)


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), third(1))), 0.7)


def op11_structure(spark, sf_dir):
    return structure.repair(structure.damage(table(spark, sf_dir, "conversations")))


def op12_substrings(spark, sf_dir):
    found = substrings.drop_repeats(table(spark, sf_dir, "documents"), k=35)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, top=5,
                          relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_warc, op3_exact_dedup, op4_packing, op5_jaccard, op6_quality, op7_sharding,
                                   op8_neighbours, op9_mixing, op10_toxicity, op11_structure, op12_substrings,
                                   op13_negatives, pipeline)}

ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # every state of the walk over a conversation's rows, cheapest first: an insert or two before a row, then its edit
    "op11_structure": """
        WITH RECURSIVE bits AS (
            SELECT list(v ORDER BY b) AS t FROM (
                SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda x, k:
                                      CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(b))),
        filled AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        hit AS (
            SELECT f.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
                            lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS hit FROM filled f, bits),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM hit, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) WHERE hit <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                   right(rtrim(text, e' \t\n\x0b\x0c\r'), 1) AS tail, left(role, 1) AS one FROM damaged),
        judged AS (
            SELECT conv_id, turn, role, text, i, one, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(one) OVER (PARTITION BY conv_id ORDER BY i) || one AS two,
                   CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
            FROM placed),
        sizes AS (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id),
        walk(conv_id, i, state, cost, audit, lines) AS (
            SELECT conv_id, 0::BIGINT, '', 0, '', []::VARCHAR[] FROM (SELECT DISTINCT conv_id FROM judged)
            UNION ALL (
            WITH more AS (
                SELECT w.conv_id, w.i, cost + 2 * k AS cost, audit || repeat('I', k) AS audit,
                       CASE WHEN k = 0 THEN state WHEN (state = 'u') = (k = 1) THEN 'a' ELSE 'u' END AS state,
                       lines || CASE WHEN k = 0 THEN []::VARCHAR[] WHEN state = 'u' THEN ['assistant:', 'user:'][1:k] ELSE ['user:', 'assistant:'][1:k] END AS lines
                FROM walk w, range(3) r(k)),
            edited AS (
                SELECT m.conv_id, m.i + 1 AS i, unnest(CASE
                    WHEN fault IN ('blank', 'duplicate') THEN [struct_pack(state := state, cost := cost + 3, audit := audit || 'D', lines := lines)]
                    ELSE list_filter([
                        struct_pack(state := state, cost := cost + 3, audit := audit || 'D', lines := lines),
                        struct_pack(state := CASE WHEN one <> '' AND state || one IN ('s', 'u', 'su', 'ua', 'au') THEN one ELSE 'x' END,
                                    cost := cost + (fault IS NOT NULL)::INT, audit := audit || 'K', lines := lines || [role || ':' || text]),
                        struct_pack(state := CASE WHEN state = 'u' THEN 'a' ELSE 'u' END, cost := cost + 2 + (fault IS NOT NULL)::INT, audit := audit || 'R',
                                    lines := lines || [CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END || text])], lambda e: e.state <> 'x') END, recursive := true)
                FROM more m JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.i = m.i + 1)
            SELECT conv_id, i, state, cost, audit, lines FROM edited
            QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1)),
        ends AS (
            SELECT w.conv_id, cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost,
                   audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
                   lines || CASE state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE []::VARCHAR[] END AS lines
            FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i),
        ended AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, e'\n'), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
             LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_substrings": """
        WITH split AS (
            SELECT doc_id, row_number() OVER () AS r,
                   list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS words FROM documents),
        starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM split),
        windows AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(words[i:i + 34], ' ')) AS n FROM starts),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS place FROM windows WHERE n > 1),
        lists AS (SELECT r, list(place) AS cut FROM gone GROUP BY r),
        kept AS (
            SELECT doc_id, len(words) AS n, coalesce(len(cut), 0) AS c, CASE WHEN cut IS NULL THEN words ELSE
                   list_transform(list_sort(list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(cut, x))), lambda x: words[x]) END AS stay
            FROM split LEFT JOIN lists USING (r))
        SELECT doc_id, n::BIGINT AS n_words, c::BIGINT AS n_removed, sha256(coalesce(array_to_string(stay, ' '), '')) AS kept_sha256 FROM kept""",
    "op13_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM whole a, whole b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER near)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW near AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER near <= 5""",
}
