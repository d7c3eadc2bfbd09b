"""The registered query of each operator: its digest columns over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import (
    chat,
    decontamination,
    jaccard,
    language_model,
    merkle,
    packing,
    pii,
    repeats,
    token_files,
    toxicity,
    url_filter,
    vector_tree,
    whitening,
)
from cliploom.llm.common import kept, table
from cliploom.llm.registry import ORACLE, QUERIES, query  # noqa: F401
from cliploom.session import scratch_path

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")
    token_files.write(docs, folder, WORD_VOCABULARY)
    return token_files.digests(spark, folder)


@query()
def op2_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_tree.search(vectors, vectors.where("vec_id % 100 = 0"))


@query(
    r"""
    WITH word AS (
        SELECT doc_id, i, w[i] AS w2, w[i - 1] AS w1, len(w) AS n
        FROM (
            SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
        )
    ),
    own AS (
        SELECT *, count(*) OVER (PARTITION BY doc_id, w2) AS own1, count(*) OVER (PARTITION BY doc_id, w1, w2) AS own2,
            count(*) OVER (PARTITION BY w2) AS all1, count(*) OVER (PARTITION BY w1, w2) AS all2 FROM word
    ),
    one AS (SELECT DISTINCT doc_id, w2 AS w1, all1 - own1 AS context FROM own),
    scored AS (
        SELECT doc_id, n, CASE WHEN i > 1 AND all2 > own2 THEN ln(all2 - own2) - ln(context)
            ELSE ln(greatest(all1 - own1, 1)) + CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END
                - ln(greatest((SELECT count(*) FROM word) - n, 1)) END AS s
        FROM own LEFT JOIN one USING (doc_id, w1)
    ),
    total AS (SELECT doc_id, any_value(n) AS n, sum(s) AS s FROM scored GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / n, 5) AS mean_log_score
    FROM documents LEFT JOIN total USING (doc_id)
    """
)
def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.scores(table(spark, sf_dir, "documents"))
    return found.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 5)})


@query(
    r"""
    WITH word AS (
        SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i, len(w) AS n
        FROM (SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
    ),
    gram AS (
        SELECT doc_id, i, n, k, list_slice(w, i - k + 1, i) AS g FROM word, (SELECT unnest(range(1, 6)) AS k) WHERE i >= k
    ),
    counted AS (
        SELECT doc_id, i, n, k, count(*) OVER (PARTITION BY g) - count(*) OVER (PARTITION BY doc_id, g) AS c FROM gram
    ),
    longest AS (SELECT doc_id, i, max(k) FILTER (k = 1 OR c > 0) AS k FROM counted GROUP BY doc_id, i),
    scored AS (
        SELECT x.doc_id, x.n, CASE WHEN x.k > 1 THEN ln(x.c) - ln(y.c)
            ELSE ln(greatest(x.c, 1)) - ln(greatest((SELECT count(*) FROM word) - x.n, 1)) END
            + (least(x.i, 5) - x.k) * ln(0.4) AS s
        FROM longest JOIN counted x USING (doc_id, i, k)
        LEFT JOIN counted y ON y.doc_id = x.doc_id AND y.i = x.i - 1 AND y.k = x.k - 1
    ),
    total AS (SELECT doc_id, any_value(n) AS n, sum(s) AS s FROM scored GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / n, 5) AS mean_log_score
    FROM documents LEFT JOIN total USING (doc_id)
    """
)
def op3_stupid_backoff_order5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.scores(table(spark, sf_dir, "documents"), order=5)
    return found.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 5)})


@query(
    r"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    gram AS (
        SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM doc WHERE len(w) > 0)
    ),
    size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
    pair AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
        FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
    ),
    link AS (
        SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
        WHERE 100 * o >= 80 * (x.n + y.n - o)
    ),
    edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
    least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id))::BIGINT AS component_id
    FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
    """
)
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    gram AS (
        SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM doc WHERE len(w) > 0)
    ),
    size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
    pair AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
        FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
    ),
    link AS (
        SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
        WHERE 100 * o >= 80 * (x.n + y.n - o)
    ),
    edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
    least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a),
    degree AS (SELECT a AS doc_id, count(*) AS d FROM edge GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id))::BIGINT AS component_id,
        coalesce(d, 0)::BIGINT AS n_links
    FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN degree USING (doc_id)
    """
)
def op4_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    rf"""
    WITH doc AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    item AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
    grams AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS gram
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT k FROM grams),
    places AS (
        SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS gram
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)
    ),
    found AS (SELECT doc_id, item_id, k, i FROM places JOIN grams USING (k, gram)),
    hit AS (
        SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id
    ),
    names AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
        coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
    """
)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    """
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
    ),
    marked AS (
        SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;'))
            + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 17 AS chars FROM said
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
    """
)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = chat.turns(table(spark, sf_dir, "conversations")).union(chat.tricky(spark))
    return chat.digests(kept(chat.formatted(said), "chat"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


SURROGATE_KEY = "cliploom"  # a deployment passes a secret of its own


@query()
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymized(docs, SURROGATE_KEY, "n_entities")


@query()
def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


# Fixed values of the contract: (action, host, path).
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "spam")  # words of host names whose pages are listed


@query(
    rf"""
    WITH page AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ),
    named AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM page),
    listed AS (
        SELECT DISTINCT canonical FROM named
        WHERE list_has_any(regexp_split_to_array(host, '[.-]'), ['{"', '".join(UNWANTED)}'])
    ),
    rule(action, host, path) AS (VALUES {", ".join(map(str, URL_RULES))}),
    fit AS (
        SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
        FROM page p JOIN rule r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY page_id
    )
    SELECT page_id, host, path, rule,
        coalesce(action, CASE WHEN host <> '' AND canonical IN (FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
    FROM named LEFT JOIN fit USING (page_id)
    """
)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = url_filter.parts(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, "[.-]"), F.lit(list(UNWANTED))))
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge(pages, rules, listed).drop("canonical", "listed")


@query(
    """
    WITH RECURSIVE field AS (
        SELECT doc_id, lang, text,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
        FROM documents
    ),
    leaf AS (
        SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
            sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h FROM field
    ),
    node AS (
        SELECT 0 AS level, lang AS tree, place, h, count(*) OVER (PARTITION BY lang) AS n FROM leaf
        UNION ALL
        SELECT level + 1, tree, place // 8, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 7) // 8
        FROM node WHERE n > 1 GROUP BY level, tree, place // 8
    ),
    subroot AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS place FROM node WHERE n = 1),
    upper AS (
        SELECT 0 AS level, place, h, count(*) OVER () AS n FROM subroot
        UNION ALL
        SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 7) // 8
        FROM upper WHERE n > 1 GROUP BY level, place // 8
    ),
    beside AS (
        SELECT l.lang, l.doc_id, 0 AS part, x.level, string_agg(x.h, '' ORDER BY x.place) AS s
        FROM leaf l JOIN node x ON x.tree IS NOT DISTINCT FROM l.lang AND x.n > 1
            AND x.place // 8 = l.place // (8 ** (x.level + 1))::BIGINT AND x.place <> l.place // (8 ** x.level)::BIGINT
        GROUP BY l.lang, l.doc_id, x.level
        UNION ALL
        SELECT l.lang, l.doc_id, 1, x.level, string_agg(x.h, '' ORDER BY x.place)
        FROM leaf l JOIN subroot r ON r.tree IS NOT DISTINCT FROM l.lang JOIN upper x ON x.n > 1
            AND x.place // 8 = r.place // (8 ** (x.level + 1))::BIGINT AND x.place <> r.place // (8 ** x.level)::BIGINT
        GROUP BY l.lang, l.doc_id, x.level
    ),
    proof AS (SELECT doc_id, sha256(string_agg(s, '' ORDER BY part, level)) AS proof_sha256 FROM beside GROUP BY doc_id),
    crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce(
            list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ),
    version AS (
        SELECT l.doc_id, l.lang AS tree, l.place, CASE WHEN xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(string_split(l.doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 3 = 0
            THEN sha256(head || coalesce(strlen(text) || ':'
                || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE l.h END AS h
        FROM leaf l JOIN field USING (doc_id), crc_table
    ),
    fold AS (
        SELECT doc_id, tree, 0 AS level, place, h FROM version
        UNION ALL
        SELECT f.doc_id, f.tree, f.level + 1, f.place // 8,
            sha256(string_agg(CASE WHEN x.place = f.place THEN f.h ELSE x.h END, '' ORDER BY x.place))
        FROM fold f JOIN node x ON x.tree IS NOT DISTINCT FROM f.tree AND x.level = f.level AND x.n > 1 AND x.place // 8 = f.place // 8
        GROUP BY f.doc_id, f.tree, f.level, f.place
    ),
    above AS (
        SELECT doc_id, 0 AS level, r.place, arg_max(f.h, f.level) AS h
        FROM fold f JOIN subroot r ON r.tree IS NOT DISTINCT FROM f.tree GROUP BY doc_id, r.place
        UNION ALL
        SELECT f.doc_id, f.level + 1, f.place // 8,
            sha256(string_agg(CASE WHEN x.place = f.place THEN f.h ELSE x.h END, '' ORDER BY x.place))
        FROM above f JOIN upper x ON x.level = f.level AND x.n > 1 AND x.place // 8 = f.place // 8 GROUP BY f.doc_id, f.level, f.place
    ),
    folded AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM above GROUP BY doc_id)
    SELECT l.doc_id, l.h AS leaf, r.h AS subroot, u.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
        folded_root, folded_root = u.h AS verified
    FROM leaf l JOIN subroot r ON r.tree IS NOT DISTINCT FROM l.lang JOIN upper u ON u.n = 1
    JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id)
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered, edits={"text": lowered})
    return merkle.proofs(found).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
