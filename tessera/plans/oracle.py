"""DuckDB twins of the named queries in :mod:`tessera.plans.catalog`.

Tables are the driver's views (lineitem, orders, part, documents, ...).
Shared fragments are spelled once here and composed into each statement.
"""

from __future__ import annotations

from tessera.functions.constants import PUNCTUATION, STOP_WORDS

RATINGS = ("SELECT o_custkey AS user_id, l_partkey AS item_id, "
           "CAST(CEIL(AVG(l_quantity) / 10) AS INT) AS rating "
           "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")


def fold(cols: list[str], k: int, salt: str = "") -> str:
    """Same bucket as :func:`tessera.functions.columns.key_hash_bucket`."""
    parts = [f"'{salt}'"] if salt else []
    for i, c in enumerate(cols):
        if i:
            parts.append("'|'")
        parts.append(f"CAST({c} AS VARCHAR)")
    return f"CAST(('0x' || substr(md5({' || '.join(parts)}), 1, 8))::UBIGINT % {k} AS BIGINT)"


SPLIT = (f"ratings AS ({RATINGS}), "
         f"folded AS (SELECT *, {fold(['user_id', 'item_id'], 10)} AS fold FROM ratings), "
         "train AS (SELECT user_id, item_id, rating FROM folded WHERE fold <> 9), "
         "test AS (SELECT user_id, item_id, rating FROM folded WHERE fold = 9)")

NEIGHBORS = ("nb AS (SELECT p.user_id AS test_user, p.item_id AS test_item, t.user_id AS train_user, "
             "t.item_id AS train_item, t.rating, "
             "sqrt(CAST((t.user_id - p.user_id) * (t.user_id - p.user_id) "
             "+ (t.item_id - p.item_id) * (t.item_id - p.item_id) AS DOUBLE)) AS dist "
             "FROM test p JOIN train t ON t.user_id BETWEEN p.user_id - 1 AND p.user_id + 1 "
             "AND t.item_id BETWEEN p.item_id - 1 AND p.item_id + 1)")

KNN = (f"WITH {SPLIT}, {NEIGHBORS}, "
       "bp AS (SELECT test_user, test_item, rating FROM (SELECT *, row_number() OVER "
       "(PARTITION BY test_user, test_item ORDER BY dist, train_user, train_item) AS rn FROM nb) WHERE rn = 1), "
       "bu AS (SELECT test_user, rating FROM (SELECT *, row_number() OVER "
       "(PARTITION BY test_user ORDER BY dist, train_user, train_item, test_item) AS rn FROM nb) WHERE rn = 1), "
       "pred AS (SELECT p.user_id, p.item_id, p.rating, "
       "CAST(COALESCE(NULLIF(bp.rating, 0), NULLIF(bu.rating, 0), 1) AS INT) AS prediction "
       "FROM test p LEFT JOIN bp ON bp.test_user = p.user_id AND bp.test_item = p.item_id "
       "LEFT JOIN bu ON bu.test_user = p.user_id)")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP_LIST = sql_list(STOP_WORDS)
PUNCT_LIT = "'" + PUNCTUATION.replace("'", "''") + "'"

ORACLE: dict[str, str] = {
    "ratings_from_orders": RATINGS,
    "lattice_neighbors": (f"WITH {SPLIT}, {NEIGHBORS} SELECT test_user, test_item, train_user, train_item, "
                          "rating, round_even(dist, 9) AS dist FROM nb"),
    "knn_predict_ratings": f"{KNN} SELECT * FROM pred",
    "knn_metrics": (f"{KNN} SELECT COUNT(*) AS n, "
                    "round_even(sqrt(AVG((prediction - rating) * (prediction - rating))), 9) AS rmse, "
                    "round_even(AVG(abs(prediction - rating)), 9) AS mae, "
                    "round_even(1 - SUM((prediction - rating) * (prediction - rating)) / "
                    "(CAST(SUM(rating * rating) AS DOUBLE) - CAST(SUM(rating) AS DOUBLE) * SUM(rating) / COUNT(*)), 9) AS r2 "
                    "FROM pred"),
}


# ------------------------------------------------------------------ phase 2
KNN_EV = (f"WITH {SPLIT}, {NEIGHBORS}, "
          "bp AS (SELECT test_user, test_item, rating FROM (SELECT *, row_number() OVER "
          "(PARTITION BY test_user, test_item ORDER BY dist, train_user, train_item) AS rn FROM nb) WHERE rn = 1), "
          "bu AS (SELECT test_user, rating FROM (SELECT *, row_number() OVER "
          "(PARTITION BY test_user ORDER BY dist, train_user, train_item, test_item) AS rn FROM nb) WHERE rn = 1), "
          "ev AS (SELECT p.user_id, p.item_id, p.rating, bp.rating AS pair_rating, bu.rating AS user_rating "
          "FROM test p LEFT JOIN bp ON bp.test_user = p.user_id AND bp.test_item = p.item_id "
          "LEFT JOIN bu ON bu.test_user = p.user_id)")

TIME_SPLIT = ("j AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity, o_orderdate "
              "FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
              "train AS (SELECT user_id, item_id, CAST(CEIL(AVG(l_quantity) / 10) AS INT) AS rating FROM j "
              "WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2), "
              "pairs AS (SELECT DISTINCT user_id, item_id FROM j WHERE o_orderdate >= TIMESTAMP '2000-01-01')")

REPAIR = (f"WITH {TIME_SPLIT}, "
          "unknown AS (SELECT item_id FROM pairs EXCEPT SELECT item_id FROM train), "
          "owners AS (SELECT item_id, MIN(user_id) AS user_id FROM pairs WHERE item_id IN (SELECT item_id FROM unknown) "
          "AND user_id IN (SELECT user_id FROM train) GROUP BY item_id), "
          "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS pick FROM owners), "
          "picks AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY "
          "md5('pick|' || CAST(user_id AS VARCHAR) || '|' || CAST(item_id AS VARCHAR)), item_id) AS pick "
          "FROM train WHERE user_id IN (SELECT user_id FROM owners)), "
          "mapping AS (SELECT r.item_id AS old, p.item_id AS new FROM ranked r JOIN picks p USING (user_id, pick)) "
          "SELECT pairs.user_id, pairs.item_id AS old_item, COALESCE(mapping.new, pairs.item_id) AS item_id "
          "FROM pairs LEFT JOIN mapping ON pairs.item_id = mapping.old")

PROFIT = ("rev AS (SELECT l_partkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1), "
          "pp AS (SELECT p_partkey, p_name, p_retailprice AS budget, revenue, p_retailprice - revenue AS profit "
          "FROM part LEFT JOIN rev ON p_partkey = l_partkey)")


def null_pct(cols: list[str], rel: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round_even(CAST(100.0 AS DOUBLE) * (COUNT(*) - COUNT({c})) / COUNT(*), 2) "
        f"AS null_pct FROM {rel}" for c in cols)


DOC_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
COLUMN_INFO = ("WITH c AS (SELECT COUNT(*) AS rows, " + ", ".join(f"COUNT({n}) AS c{i}" for i, (n, _) in enumerate(DOC_COLS))
               + " FROM documents) " + " UNION ALL ".join(
                   f"SELECT {i + 1} AS position, '{n}' AS \"column\", '{t}' AS dtype, c{i} AS non_null, rows FROM c"
                   for i, (n, t) in enumerate(DOC_COLS)))

ORACLE.update({
    "missing_keys_in_training": (f"WITH {TIME_SPLIT} SELECT "
                                 "(SELECT COUNT(*) FROM (SELECT user_id FROM pairs EXCEPT SELECT user_id FROM train)) "
                                 "AS missing_users, "
                                 "(SELECT COUNT(*) FROM (SELECT item_id FROM pairs EXCEPT SELECT item_id FROM train)) "
                                 "AS missing_items"),
    "repair_unknown_items": REPAIR,
    "replace_values": (f"WITH {SPLIT} SELECT user_id, CAST(CASE item_id WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 "
                       "ELSE item_id END AS BIGINT) AS item_id, rating FROM train"),
    "filter_user": f"SELECT * FROM ({RATINGS}) WHERE user_id = 7",
    "null_profile": f"{KNN_EV} {null_pct(['user_id', 'item_id', 'rating', 'pair_rating', 'user_rating'], 'ev')}",
    "column_info": COLUMN_INFO,
    "numeric_coercion": "SELECT page_id, TRY_CAST(string_split(url, '/')[-1] AS DOUBLE) AS url_number FROM pages",
    "derived_profit": (f"WITH {PROFIT} SELECT p_partkey, round_even(budget, 4) AS budget, "
                       "round_even(revenue, 4) AS revenue, round_even(profit, 4) AS profit FROM pp"),
    "dedupe_keep_first": (f"WITH {PROFIT}, r AS (SELECT *, row_number() OVER (PARTITION BY p_name "
                          "ORDER BY profit DESC NULLS LAST, p_partkey) AS rn FROM pp) "
                          "SELECT p_name, p_partkey, round_even(profit, 4) AS profit FROM r WHERE rn = 1"),
    "drop_nulls": (f"{KNN_EV} SELECT user_id, item_id, pair_rating, user_rating FROM ev "
                   "WHERE pair_rating IS NOT NULL AND user_rating IS NOT NULL"),
    "fold_sizes": (f"SELECT fold, COUNT(*) AS n FROM (SELECT {fold(['user_id', 'item_id'], 10)} AS fold "
                   f"FROM ({RATINGS})) GROUP BY fold"),
    "prefix_split": ("SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle' || CAST(doc_id AS VARCHAR)), doc_id) "
                     "<= 400 AS is_test FROM documents"),
})


# ------------------------------------------------------------------ phase 4: text
def tok(text: str = "text") -> str:
    from tessera.functions.constants import TOKEN_PATTERN
    return f"regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')"


def brk(w: str) -> str:
    return f"(list_contains({STOP_LIST}, {w}) OR instr({PUNCT_LIT}, {w}) > 0)"


RAW_FREQ = f"raw AS (SELECT word, COUNT(*) AS n FROM (SELECT unnest({tok()}) AS word FROM documents) GROUP BY word)"
CLEAN_FREQ = (f"cl AS (SELECT word, COUNT(*) AS n FROM (SELECT unnest({tok()}) AS word FROM documents) "
              f"WHERE NOT {brk('word')} GROUP BY word)")
POS_TOKENS = (f"t AS (SELECT doc_id, unnest({tok()}) AS w, generate_subscripts({tok()}, 1) AS pos FROM documents)")


def ranked_words(first: int, last: int) -> str:
    return (f"WITH {CLEAN_FREQ}, r AS (SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) AS INT) AS rank "
            f"FROM cl) SELECT word, n, rank FROM r WHERE rank BETWEEN {first} AND {last}")


ORACLE.update({
    "word_freq_raw": f"WITH {RAW_FREQ} SELECT * FROM raw",
    "word_freq_clean": f"WITH {CLEAN_FREQ} SELECT * FROM cl",
    "freq_summary": (f"WITH {RAW_FREQ}, {CLEAN_FREQ} "
                     "SELECT COUNT(*) AS samples, CAST(SUM(n) AS BIGINT) AS outcomes, 'raw' AS stage FROM raw "
                     "UNION ALL SELECT COUNT(*), CAST(SUM(n) AS BIGINT), 'clean' FROM cl"),
    "top_words": ranked_words(1, 10),
    "rank_range_words": ranked_words(1991, 2000),
    "corpus_counts": (f"SELECT label, COUNT(*) AS documents, CAST(SUM(len({tok('d.text')})) AS BIGINT) AS words "
                      "FROM documents d JOIN (SELECT doc_id, CAST(quality AS INT) AS label FROM labels) l "
                      "USING (doc_id) GROUP BY ROLLUP (label)"),
    "word_degrees": (f"WITH {POS_TOKENS}, "
                     f"g AS (SELECT doc_id, pos, w, {brk('w')} AS br FROM t), "
                     "h AS (SELECT *, SUM(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos "
                     "ROWS UNBOUNDED PRECEDING) AS ph FROM g), "
                     "p AS (SELECT doc_id, ph, COUNT(*) AS plen FROM h WHERE NOT br GROUP BY doc_id, ph) "
                     "SELECT h.doc_id, h.w AS word, CAST(SUM(p.plen) AS BIGINT) AS degree "
                     "FROM h JOIN p USING (doc_id, ph) WHERE NOT h.br GROUP BY h.doc_id, h.w"),
    "key_words": (f"WITH {POS_TOKENS}, "
                  f"c AS (SELECT doc_id, w, MIN(pos) AS first_pos FROM t WHERE NOT {brk('w')} GROUP BY doc_id, w), "
                  "r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS rk FROM c) "
                  "SELECT doc_id, CAST(rk AS INT) AS kw_rank, w AS word FROM r WHERE rk <= 10"),
    "tfidf_top_terms": (f"WITH c AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({tok()}) AS term FROM documents) "
                        f"WHERE NOT {brk('term')}), "
                        "tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM c GROUP BY doc_id, term), "
                        "df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term), "
                        "nd AS (SELECT COUNT(*) AS n FROM documents), "
                        "s AS (SELECT tf.doc_id, tf.term, tf.tf, df.df, "
                        "tf.tf * ln((CAST(nd.n AS DOUBLE) + 1.0) / (df.df + 1)) AS tfidf "
                        "FROM tf JOIN df USING (term) CROSS JOIN nd), "
                        "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank "
                        "FROM s) "
                        "SELECT doc_id, CAST(rank AS INT) AS rank, term, tf, df, round_even(tfidf, 6) AS tfidf "
                        "FROM r WHERE rank <= 5"),
})


# ------------------------------------------------------------------ phase 4: naive Bayes
NB = ("WITH docs AS (SELECT d.doc_id, CAST(l.quality AS INT) AS label, "
      f"{fold(['d.doc_id'], 5, 'nb')} = 0 AS is_test, "
      f"list_filter({tok('d.text')}, lambda w: NOT {brk('w')}) AS tokens "
      "FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
      "words AS (SELECT doc_id, label, is_test, unnest(tokens) AS word FROM docs), "
      "freq AS (SELECT word, COUNT(*) AS n FROM words GROUP BY word), "
      "vocab AS (SELECT word FROM freq ORDER BY n DESC, word LIMIT 2000), "
      "present AS (SELECT DISTINCT w.doc_id, w.label, w.is_test, w.word FROM words w JOIN vocab v ON w.word = v.word), "
      "classes AS (SELECT label, COUNT(*) AS n_docs FROM docs WHERE NOT is_test GROUP BY label), "
      "stats AS (SELECT label, n_docs, (CAST(n_docs AS DOUBLE) + 0.5) / "
      "(SUM(n_docs) OVER () + 0.5 * (SELECT COUNT(*) FROM classes)) AS prior FROM classes), "
      "counts AS (SELECT label, word, COUNT(*) AS n_cw FROM present WHERE NOT is_test GROUP BY label, word), "
      "theta AS (SELECT c.label, v.word, COALESCE(k.n_cw, 0) AS n_cw, "
      "(CAST(COALESCE(k.n_cw, 0) AS DOUBLE) + 0.5) / (CAST(c.n_docs AS DOUBLE) + 1.0) AS theta "
      "FROM classes c CROSS JOIN vocab v LEFT JOIN counts k ON k.label = c.label AND k.word = v.word), "
      "base AS (SELECT s.label, ln(s.prior) + SUM(ln(1 - t.theta)) AS base FROM stats s JOIN theta t "
      "ON s.label = t.label GROUP BY s.label, s.prior), "
      "delta AS (SELECT p.doc_id, t.label, SUM(ln(t.theta) - ln(1 - t.theta)) AS d FROM present p JOIN theta t "
      "ON p.word = t.word GROUP BY p.doc_id, t.label), "
      "scores AS (SELECT d.doc_id, b.label AS cls, b.base + COALESCE(x.d, 0) AS score FROM docs d CROSS JOIN base b "
      "LEFT JOIN delta x ON x.doc_id = d.doc_id AND x.label = b.label), "
      "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cls) AS rn, "
      "MAX(score) OVER (PARTITION BY doc_id) AS m FROM scores), "
      "probs AS (SELECT doc_id, MAX(CASE WHEN rn = 1 THEN cls END) AS prediction, SUM(exp(score - m)) AS z, "
      "MAX(CASE WHEN cls = 0 THEN exp(score - m) END) AS e0, MAX(CASE WHEN cls = 1 THEN exp(score - m) END) AS e1 "
      "FROM ranked GROUP BY doc_id)")

ORACLE.update({
    "presence_features": f"{NB} SELECT doc_id, word FROM present",
    "nb_class_word_counts": f"{NB} SELECT label, word, n_cw FROM counts",
    "nb_priors": f"{NB} SELECT label, n_docs, round_even(prior, 9) AS prior FROM stats",
    "nb_likelihoods": f"{NB} SELECT label, word, n_cw, round_even(theta, 9) AS theta FROM theta",
    "nb_predictions": (f"{NB} SELECT d.doc_id, d.label, p.prediction, round_even(p.e0 / p.z, 6) AS p_0, "
                       "round_even(p.e1 / p.z, 6) AS p_1 FROM docs d JOIN probs p ON d.doc_id = p.doc_id "
                       "WHERE d.is_test"),
    "nb_accuracy": (f"{NB} SELECT d.is_test, COUNT(*) AS n, "
                    "round_even(AVG(CAST(p.prediction = d.label AS DOUBLE)), 9) AS accuracy "
                    "FROM docs d JOIN probs p ON d.doc_id = p.doc_id GROUP BY d.is_test"),
    "nb_informative": (f"{NB}, pv AS (SELECT word, label, TRUE AS present, theta AS p FROM theta UNION ALL "
                       "SELECT word, label, FALSE AS present, 1 - theta AS p FROM theta), "
                       "lm AS (SELECT word, present, label AS label_max FROM (SELECT *, row_number() OVER "
                       "(PARTITION BY word, present ORDER BY p DESC, label) AS rn FROM pv) WHERE rn = 1), "
                       "ag AS (SELECT word, present, MAX(p) / MIN(p) AS ratio FROM pv GROUP BY word, present) "
                       "SELECT ag.word, ag.present, round_even(ag.ratio, 6) AS ratio, lm.label_max FROM ag "
                       "JOIN lm ON ag.word = lm.word AND ag.present = lm.present "
                       "ORDER BY ag.ratio DESC, ag.word, ag.present DESC LIMIT 10"),
})


# ------------------------------------------------------------------ phase 3: ridge
RIDGE = ("a AS (SELECT AVG(user_id) AS m1, AVG(item_id) AS m2, AVG(rating) AS my, stddev_pop(user_id) AS s1, "
         "stddev_pop(item_id) AS s2, stddev_pop(rating) AS sy, corr(user_id, item_id) AS r12, "
         "corr(user_id, rating) AS r1y, corr(item_id, rating) AS r2y FROM train), "
         "l AS (SELECT *, 0.3 / sy AS lam FROM a), "
         "w AS (SELECT *, ((1 + lam) * r1y - r12 * r2y) / ((1 + lam) * (1 + lam) - r12 * r12) AS w1, "
         "((1 + lam) * r2y - r12 * r1y) / ((1 + lam) * (1 + lam) - r12 * r12) AS w2 FROM l), "
         "b AS (SELECT w1 * sy / s1 AS b1, w2 * sy / s2 AS b2, "
         "my - (w1 * sy / s1) * m1 - (w2 * sy / s2) * m2 AS b0 FROM w)")

BASELINE = ("mu AS (SELECT AVG(rating) AS mu FROM train), "
            "bi AS (SELECT item_id, SUM(rating - mu) / (CAST(10 AS DOUBLE) + COUNT(*)) AS b_i "
            "FROM train CROSS JOIN mu GROUP BY item_id), "
            "bu AS (SELECT t.user_id, SUM(t.rating - mu - bi.b_i) / (CAST(15 AS DOUBLE) + COUNT(*)) AS b_u "
            "FROM train t JOIN bi ON t.item_id = bi.item_id CROSS JOIN mu GROUP BY t.user_id)")

CV_BASELINE = (f"WITH ratings AS ({RATINGS}), "
               f"f AS (SELECT *, {fold(['user_id', 'item_id'], 5, 'cv')} AS fold FROM ratings), "
               "tr AS (SELECT f.user_id, f.item_id, f.rating, c.cv_fold FROM f CROSS JOIN "
               "(SELECT CAST(range AS INT) AS cv_fold FROM range(5)) c WHERE c.cv_fold <> f.fold), "
               "mu AS (SELECT cv_fold, AVG(rating) AS mu FROM tr GROUP BY cv_fold), "
               "bi AS (SELECT tr.cv_fold, item_id, SUM(rating - mu) / (CAST(10 AS DOUBLE) + COUNT(*)) AS b_i "
               "FROM tr JOIN mu ON tr.cv_fold = mu.cv_fold GROUP BY tr.cv_fold, item_id), "
               "bu AS (SELECT tr.cv_fold, tr.user_id, SUM(tr.rating - mu.mu - bi.b_i) / (CAST(15 AS DOUBLE) + COUNT(*)) "
               "AS b_u FROM tr JOIN mu ON tr.cv_fold = mu.cv_fold JOIN bi ON tr.cv_fold = bi.cv_fold "
               "AND tr.item_id = bi.item_id GROUP BY tr.cv_fold, tr.user_id), "
               "p AS (SELECT f.fold, f.rating, least(5.0, greatest(1.0, mu.mu + COALESCE(bu.b_u, 0) "
               "+ COALESCE(bi.b_i, 0))) AS prediction FROM f JOIN mu ON mu.cv_fold = f.fold "
               "LEFT JOIN bi ON bi.cv_fold = f.fold AND bi.item_id = f.item_id "
               "LEFT JOIN bu ON bu.cv_fold = f.fold AND bu.user_id = f.user_id) "
               "SELECT CAST(fold AS INT) AS fold, COUNT(*) AS n, "
               "round_even(sqrt(AVG((prediction - rating) * (prediction - rating))), 6) AS rmse, "
               "round_even(AVG(abs(prediction - rating)), 6) AS mae FROM p GROUP BY fold")

EMB = "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
EMB_CELLS = ("cells AS (SELECT vec_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INT) AS col FROM emb)")

KW_PART = (f"t AS (SELECT p_partkey, unnest({tok('p_name')}) AS w, generate_subscripts({tok('p_name')}, 1) AS pos "
           "FROM part), "
           f"c AS (SELECT p_partkey, w, MIN(pos) AS first_pos FROM t WHERE NOT {brk('w')} GROUP BY p_partkey, w), "
           "r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY first_pos) AS rk FROM c), "
           "kw AS (SELECT p_partkey, string_agg(w, ' ' ORDER BY first_pos) AS kw FROM r WHERE rk <= 10 "
           "GROUP BY p_partkey), "
           "bags AS (SELECT part.p_partkey, concat_ws(' ', lower(p_type), lower(p_brand), CAST(p_size AS VARCHAR), "
           "COALESCE(kw.kw, '')) AS bag FROM part LEFT JOIN kw ON part.p_partkey = kw.p_partkey)")


def _cv_parts() -> str:
    from tessera.functions.constants import COUNT_TOKEN_PATTERN
    return (f"{KW_PART}, cv AS (SELECT p_partkey, term, COUNT(*) AS n FROM (SELECT p_partkey, "
            f"unnest(regexp_extract_all(lower(bag), '{COUNT_TOKEN_PATTERN}')) AS term FROM bags) "
            "GROUP BY p_partkey, term), "
            "nrm AS (SELECT p_partkey, sqrt(SUM(n * n)) AS norm FROM cv GROUP BY p_partkey), "
            "q AS (SELECT term, n AS qn FROM cv WHERE p_partkey = 1), "
            "qn AS (SELECT sqrt(SUM(qn * qn)) AS q FROM q)")


CV_PARTS = _cv_parts()

ORACLE.update({
    "ridge_coefficients": (f"WITH {SPLIT}, {RIDGE} SELECT 'user_id' AS term, round_even(b1, 9) AS value FROM b "
                           "UNION ALL SELECT 'item_id', round_even(b2, 9) FROM b "
                           "UNION ALL SELECT 'intercept', round_even(b0, 9) FROM b"),
    "ridge_closed_form": (f"WITH {SPLIT}, {RIDGE} SELECT round_even(b1, 9) AS b1, round_even(b2, 9) AS b2, "
                          "round_even(b0, 9) AS b0 FROM b"),
    "ridge_predictions": (f"WITH {SPLIT}, {RIDGE} SELECT user_id, item_id, rating, "
                          "round_even(b0 + b1 * user_id + b2 * item_id, 6) AS prediction FROM test CROSS JOIN b"),
    "ridge_metrics": (f"WITH {SPLIT}, {RIDGE}, p AS (SELECT rating, b0 + b1 * user_id + b2 * item_id AS prediction "
                      "FROM train CROSS JOIN b) SELECT COUNT(*) AS n, "
                      "round_even(sqrt(AVG((prediction - rating) * (prediction - rating))), 6) AS rmse, "
                      "round_even(AVG(abs(prediction - rating)), 6) AS mae, "
                      "round_even(1 - SUM((prediction - rating) * (prediction - rating)) / "
                      "(CAST(SUM(rating * rating) AS DOUBLE) - CAST(SUM(rating) AS DOUBLE) * SUM(rating) / COUNT(*)), 6)"
                      " AS r2 FROM p"),
    "lsh_neighbors": ORACLE["lattice_neighbors"],
    "baseline_predictions": (f"WITH {SPLIT}, {BASELINE} SELECT p.user_id, p.item_id, p.rating, "
                             "round_even(least(5.0, greatest(1.0, mu + COALESCE(b_u, 0) + COALESCE(b_i, 0))), 6) "
                             "AS prediction FROM test p CROSS JOIN mu LEFT JOIN bi ON bi.item_id = p.item_id "
                             "LEFT JOIN bu ON bu.user_id = p.user_id"),
    "baseline_cv": CV_BASELINE,
    "item_means": (f"WITH ratings AS ({RATINGS}) SELECT item_id, round_even(SUM(rating) / "
                   "(SELECT CAST(COUNT(DISTINCT user_id) AS DOUBLE) FROM ratings), 9) AS mean "
                   "FROM ratings GROUP BY item_id"),
    "matrix_extent": (f"SELECT MAX(item_id) AS max_item, MAX(user_id) AS max_user, COUNT(DISTINCT user_id) AS n_users, "
                      f"COUNT(DISTINCT item_id) AS n_items, COUNT(*) AS n_ratings FROM ({RATINGS})"),
    "utility_triples": ("WITH ev AS (SELECT o_custkey AS user_id, l_partkey AS item_id, "
                        "CAST(CEIL(l_quantity / 10) AS INT) AS rating, o_orderdate, l_orderkey, l_linenumber "
                        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
                        "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id "
                        "ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) AS rn FROM ev) "
                        "SELECT user_id, item_id, rating FROM r WHERE rn = 1"),
    "sparse_triples": f"WITH {EMB}, {EMB_CELLS} SELECT vec_id AS item_id, col, x AS value FROM cells WHERE x <> 0",
    "dense_roundtrip": "SELECT vec_id AS item_id, TRUE AS same FROM embeddings",
    "embedding_covariance": (f"WITH {EMB}, {EMB_CELLS} SELECT a.col AS i, b.col AS j, "
                             "round_even(covar_pop(a.x, b.x), 9) AS cov FROM cells a JOIN cells b "
                             "ON a.vec_id = b.vec_id GROUP BY a.col, b.col"),
    "top_cosine_vectors": (f"WITH {EMB}, q AS (SELECT v AS qv FROM emb WHERE vec_id = 0), "
                           "s AS (SELECT vec_id AS item_id, list_dot_product(v, qv) / "
                           "(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS score "
                           "FROM emb CROSS JOIN q), "
                           "r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INT) AS rank FROM s) "
                           "SELECT item_id, round_even(score, 6) AS score, rank FROM r WHERE rank <= 10"),
    "bag_of_words_parts": f"WITH {KW_PART} SELECT p_partkey, bag FROM bags",
    "count_vectors_parts": f"WITH {CV_PARTS} SELECT p_partkey, term, n FROM cv",
    "recommend_similar_parts": (f"WITH {CV_PARTS}, "
                                "d AS (SELECT cv.p_partkey, SUM(cv.n * q.qn) AS dot FROM cv JOIN q ON cv.term = q.term "
                                "GROUP BY cv.p_partkey), "
                                "s AS (SELECT nrm.p_partkey, COALESCE(d.dot, 0) / ((SELECT q FROM qn) * nrm.norm) "
                                "AS score FROM nrm LEFT JOIN d ON nrm.p_partkey = d.p_partkey WHERE nrm.p_partkey <> 1), "
                                "rr AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INT) AS rank "
                                "FROM s) SELECT p_partkey, round_even(score, 6) AS score, rank FROM rr WHERE rank <= 10"),
    "jaccard_to_query_part": (f"WITH {CV_PARTS}, "
                              "qs AS (SELECT COUNT(DISTINCT term) AS qsize FROM q), "
                              "sz AS (SELECT p_partkey, COUNT(DISTINCT term) AS size FROM cv GROUP BY p_partkey), "
                              "it AS (SELECT cv.p_partkey, COUNT(DISTINCT cv.term) AS inter FROM cv JOIN q "
                              "ON cv.term = q.term GROUP BY cv.p_partkey) "
                              "SELECT it.p_partkey, round_even(CAST(inter AS DOUBLE) / (qsize + size - inter), 9) "
                              "AS jaccard FROM it JOIN sz ON it.p_partkey = sz.p_partkey CROSS JOIN qs"),
    "json_props_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "order_year": ("SELECT o_orderkey, CAST(year(CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP)) AS INT) AS year "
                   "FROM orders"),
})


ORACLE.update({
    "recommend_similar_titles": (f"WITH {CV_PARTS}, "
                                 "d AS (SELECT cv.p_partkey, SUM(cv.n * q.qn) AS dot FROM cv JOIN q ON cv.term = q.term "
                                 "GROUP BY cv.p_partkey), "
                                 "s AS (SELECT nrm.p_partkey, COALESCE(d.dot, 0) / ((SELECT q FROM qn) * nrm.norm) "
                                 "AS score FROM nrm LEFT JOIN d ON nrm.p_partkey = d.p_partkey WHERE nrm.p_partkey <> 1), "
                                 "rr AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INT) AS rank "
                                 "FROM s) SELECT rr.rank, rr.p_partkey, part.p_name, round_even(rr.score, 6) AS score "
                                 "FROM rr JOIN part ON rr.p_partkey = part.p_partkey WHERE rr.rank <= 10"),
    "ridge_residuals": (f"WITH {SPLIT}, {RIDGE} SELECT user_id, item_id, "
                        "round_even(rating - (b0 + b1 * user_id + b2 * item_id), 6) AS residual FROM train CROSS JOIN b"),
    "top_profit_parts": (f"WITH {PROFIT} SELECT p_partkey, p_name, round_even(profit, 4) AS profit FROM pp "
                         "ORDER BY profit DESC NULLS LAST, p_partkey LIMIT 3"),
    "hash_sample_user": (f"SELECT * FROM ({RATINGS}) WHERE user_id = 7 AND "
                         f"{fold(['user_id', 'item_id'], 1000000, 'sample')} < 900000"),
    "item_item_cosine": (f"WITH ratings AS ({RATINGS}), "
                         "q AS (SELECT user_id, CAST(rating AS DOUBLE) AS rq FROM ratings WHERE item_id = 1), "
                         "qn AS (SELECT sqrt(SUM(rq * rq)) AS q FROM q), "
                         "d AS (SELECT r.item_id, SUM(r.rating * q.rq) AS dot FROM ratings r JOIN q "
                         "ON r.user_id = q.user_id GROUP BY r.item_id), "
                         "nrm AS (SELECT item_id, sqrt(SUM(CAST(rating AS DOUBLE) * rating)) AS norm FROM ratings "
                         "GROUP BY item_id), "
                         "s AS (SELECT nrm.item_id, COALESCE(d.dot, 0) / ((SELECT q FROM qn) * nrm.norm) AS score "
                         "FROM nrm LEFT JOIN d ON nrm.item_id = d.item_id WHERE nrm.item_id <> 1), "
                         "rr AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INT) AS rank FROM s) "
                         "SELECT item_id, round_even(score, 6) AS score, rank FROM rr WHERE rank <= 10"),
})


# ------------------------- similar profiles, query sets, the centred matrix
PROFILES = (f"cells AS (SELECT item_id, {fold(['user_id'], 64, 'cell')} AS cell, "
            f"SUM(CAST(rating AS BIGINT) * ({fold(['user_id'], 2, 'sign')} * 2 - 1)) AS x FROM train GROUP BY 1, 2), "
            "dots AS (SELECT a.item_id AS i, b.item_id AS j, CAST(SUM(a.x * b.x) AS DOUBLE) AS dot FROM cells a JOIN cells b "
            "ON a.cell = b.cell GROUP BY 1, 2), "
            "sizes AS (SELECT item_id, CAST(SUM(x * x) AS DOUBLE) AS s FROM cells GROUP BY 1)")

COSINE_SET = ("q AS (SELECT {user} AS u, {item} AS query, CAST(rating AS DOUBLE) AS rq FROM ratings WHERE {item} BETWEEN 1 AND 20), "
              "nrm AS (SELECT {item} AS k, sqrt(SUM(CAST(rating AS DOUBLE) * rating)) AS norm FROM ratings GROUP BY 1), "
              "d AS (SELECT query, {item} AS k, SUM(rating * rq) AS dot FROM ratings JOIN q ON {user} = u GROUP BY 1, 2), "
              "s AS (SELECT n.k AS query, m.k, COALESCE(dot, 0) / (n.norm * m.norm) AS score FROM nrm n CROSS JOIN nrm m "
              "LEFT JOIN d ON d.query = n.k AND d.k = m.k WHERE n.k BETWEEN 1 AND 20 AND n.k <> m.k), "
              "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, k) AS INT) AS rank FROM s) "
              "SELECT query, k AS {item}, round_even(score, 6) AS score, rank FROM r WHERE rank <= 10")

CENTRED = ("nu AS (SELECT CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS n FROM {of}), "
           "means AS (SELECT item_id, SUM(rating) / (SELECT n FROM nu) AS m FROM {of} GROUP BY 1)")

ITEM_SPLIT = (f"ratings AS ({RATINGS}), "
              f"train AS (SELECT * FROM ratings WHERE {fold(['item_id'], 10, 'new')} <> 0), "
              f"pairs AS (SELECT user_id, item_id FROM ratings WHERE {fold(['user_id', 'item_id'], 50, 'ask')} = 0)")

BAGS = f"WITH {CV_PARTS}, sets AS (SELECT p_partkey AS k, list_sort(list(DISTINCT term)) AS s FROM cv GROUP BY 1)"

ORACLE.update({
    "item_cf_predictions": (f"WITH {SPLIT}, {PROFILES}, "
                            "near AS (SELECT p.user_id, p.item_id, t.item_id AS j, t.rating AS r, dot / sqrt(a.s * b.s) AS sim FROM test p "
                            "JOIN train t ON t.user_id = p.user_id AND t.item_id <> p.item_id JOIN dots ON i = p.item_id AND j = t.item_id "
                            "JOIN sizes a ON a.item_id = p.item_id JOIN sizes b ON b.item_id = t.item_id WHERE dot > 0), "
                            "best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, j) <= 20), "
                            "est AS (SELECT user_id, item_id, SUM(sim * r) / SUM(sim) AS e, COUNT(*) AS n FROM best GROUP BY 1, 2) "
                            "SELECT test.user_id, test.item_id, rating, round_even(least(5.0, greatest(1.0, COALESCE(e, "
                            "(SELECT AVG(rating) FROM train)))), 6) AS prediction, CAST(COALESCE(n, 0) AS INT) AS n_neighbors "
                            "FROM test LEFT JOIN est ON est.user_id = test.user_id AND est.item_id = test.item_id"),
    "minhash_part_pairs": (f"{BAGS}, reps AS (SELECT s, MIN(k) AS k FROM sets GROUP BY s), "
                           "j AS (SELECT a.k AS a, b.k AS b, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) AS c, len(a.s) + len(b.s) AS n "
                           "FROM reps a JOIN reps b ON a.k < b.k) SELECT a, b, round_even(c / (n - c), 9) AS jaccard FROM j WHERE c / (n - c) >= 0.7"),
    "minhash_part_classes": f"{BAGS} SELECT k AS p_partkey, MIN(k) OVER (PARTITION BY s) AS rep FROM sets",
    "column_similarities": (f"WITH ratings AS ({RATINGS}), "
                            "norms AS (SELECT item_id, sqrt(SUM(CAST(rating AS DOUBLE) * rating)) AS norm FROM ratings GROUP BY 1), "
                            "g AS (SELECT sqrt(4.0 * ln(COUNT(*)) / 0.1) AS g FROM norms), "
                            "kept AS (SELECT user_id, item_id, rating / least(g, norm) AS w FROM ratings JOIN norms USING (item_id) CROSS JOIN g "
                            f"WHERE {fold(['user_id', 'item_id'], 1 << 20, 'dimsum')} < ceil(least(1.0, g / norm) * {1 << 20})) "
                            "SELECT a.item_id AS a, b.item_id AS b, round_even(SUM(a.w * b.w), 6) AS cosine FROM kept a JOIN kept b "
                            "ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING SUM(a.w * b.w) >= 0.1"),
    "top_cosine_query_set": (f"WITH {EMB}, s AS (SELECT a.vec_id AS query, b.vec_id AS item_id, list_dot_product(a.v, b.v) / "
                             "(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM emb a JOIN emb b "
                             "ON a.vec_id < 50 AND a.vec_id <> b.vec_id), "
                             "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS INT) AS rank FROM s) "
                             "SELECT query, item_id, round_even(score, 6) AS score, rank FROM r WHERE rank <= 10"),
    "euclidean_to_query": (f"WITH {EMB}, s AS (SELECT b.vec_id AS item_id, list_distance(a.v, b.v) AS dist FROM emb a JOIN emb b "
                           "ON a.vec_id = 0 AND b.vec_id <> 0), "
                           "r AS (SELECT *, CAST(row_number() OVER (ORDER BY dist, item_id) AS INT) AS rank FROM s) "
                           "SELECT item_id, round_even(dist, 6) AS dist, rank FROM r WHERE rank <= 10"),
    "lsh_vector_pairs": ("WITH v AS (SELECT MIN(p_partkey) AS k, [CAST(p_retailprice AS DOUBLE), CAST(p_size AS DOUBLE)] AS v FROM part GROUP BY 2) "
                         "SELECT a.k AS a, b.k AS b, round_even(list_distance(a.v, b.v), 6) AS dist FROM v a JOIN v b "
                         "ON a.k < b.k WHERE list_distance(a.v, b.v) <= 1.05"),
    "item_item_cosine_set": f"WITH ratings AS ({RATINGS}), {COSINE_SET.format(user='user_id', item='item_id')}",
    "user_user_cosine_set": f"WITH ratings AS ({RATINGS}), {COSINE_SET.format(user='item_id', item='user_id')}",
    "centred_entries": (f"WITH {SPLIT}, {CENTRED.format(of='train')}, users AS (SELECT DISTINCT user_id FROM train) "
                        "SELECT p.item_id, p.user_id, CASE WHEN users.user_id IS NOT NULL THEN round_even(COALESCE(t.rating, 0) - m, 9) END AS value "
                        "FROM test p LEFT JOIN means USING (item_id) LEFT JOIN train t ON t.user_id = p.user_id AND t.item_id = p.item_id "
                        "LEFT JOIN users ON users.user_id = p.user_id"),
    "scaled_inner_products": (f"WITH ratings AS ({RATINGS}), {CENTRED.format(of='ratings')}, "
                              "dots AS (SELECT a.item_id AS a, SUM(a.rating * b.rating) AS dot FROM ratings a JOIN ratings b "
                              "ON a.user_id = b.user_id AND b.item_id = a.item_id + 1 GROUP BY 1) "
                              "SELECT x.item_id AS a, y.item_id AS b, round_even(COALESCE(dot, 0) / (SELECT n FROM nu) - x.m * y.m, 9) AS cov "
                              "FROM means x JOIN means y ON y.item_id = x.item_id + 1 LEFT JOIN dots ON dots.a = x.item_id"),
    "missing_keys_by_item": f"WITH {ITEM_SPLIT} SELECT item_id FROM pairs EXCEPT SELECT item_id FROM train",
    "repair_items_by_item": REPAIR.replace(TIME_SPLIT, ITEM_SPLIT),
})
