"""The registered queries of this package, each beside the SQL it has to agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import (
    alignment,
    bpe,
    divergence,
    exact_dedup,
    language,
    license_runs,
    licenses,
    line_dedup,
    near_dup,
    packing,
    quality,
    sharding,
    token_counts,
    url_filter,
)
from tidemill.llm.common import read_table
from tidemill.plans.registry import Plan
from tidemill.shared import new_folder

QUERIES: dict[str, Plan] = {}

#: SQL for CRC-32: the 256 checksums of single bytes by their definition, and the
#: checksum of the bytes of ``h``, a string of hexadecimal digits.
CRC_TABLE = """
    bits AS (
      SELECT range AS n, range AS c, 0 AS k FROM range(256)
      UNION ALL
      SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
      FROM bits WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(1, length(h) // 2 + 1),
          lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
        lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295)"""


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = Plan(run.__name__, run, sql)
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query(
    r"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    places AS (
      SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
      FROM texts WHERE len(words) > 0),
    shingles AS (
      SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
      FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
    links AS (
      SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
      WHERE 100 * k >= 75 * (a.n + b.n - k)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION
      SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
    """
)
def op1_near_dedup(spark, sf_dir):
    groups = near_dup.near_groups(documents(spark, sf_dir))
    return groups.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query()
def op2_packing(spark, sf_dir):
    return packing.pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")
    )


def _url_level(depth: int) -> str:
    """One level of the tree: ``t{depth}`` extends the templates of ``t{depth - 1}``."""
    u = url_filter
    old, seg = f"t{depth}", f"segments[{depth + 1}]"
    return f"""
    b{depth} AS (
      SELECT host, template, {seg} AS segment, sum(pages) AS pages, sum(good) AS good,
             sum(labels) AS labels
      FROM {old} WHERE len(segments) > {depth} GROUP BY ALL),
    s{depth} AS (
      SELECT *, sum(pages) OVER w AS all_pages, sum(good) OVER w AS all_good,
             sum(labels) OVER w AS all_labels
      FROM b{depth} WINDOW w AS (PARTITION BY host, template)),
    k{depth} AS (
      SELECT host, template, segment FROM (
        SELECT *, good / labels::DOUBLE - (all_good - good) / (all_labels - labels)::DOUBLE AS gap,
               all_good / all_labels::DOUBLE AS share
        FROM s{depth}
        WHERE pages >= {u.COMMON_PAGES} AND pages * 100 >= {u.COMMON_SHARE} * all_pages
          AND labels > 0 AND all_labels > labels AND all_good > 0 AND all_good < all_labels)
      WHERE gap * gap > {u.APART} * (share * (1.0 - share)
        * (1.0 / labels::DOUBLE + 1.0 / (all_labels - labels)::DOUBLE))),
    t{depth + 1} AS (
      SELECT t.host, segments, pages, good, labels, CASE WHEN len(segments) <= {depth} THEN t.template
             ELSE t.template || '/' || coalesce(k.segment, '*') END AS template
      FROM {old} t LEFT JOIN k{depth} k
        ON k.host = t.host AND k.template = t.template AND k.segment = {seg}),"""


@query(
    rf"""
    WITH cut AS (
      SELECT page_id, url, strpos(coalesce(url, ''), '://') AS spot FROM pages),
    parts AS (
      SELECT page_id,
        CASE WHEN spot = 0 THEN '' ELSE translate(regexp_extract(substr(url, spot + 3), '^[^/?#]*'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
        CASE WHEN spot = 0 THEN '' ELSE regexp_extract(
          substr(url, spot + 3), '^[^/?#]*([^?#]*)', 1) END AS path
      FROM cut),
    segmented AS (
      SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
                  lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS masked,
             regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS name
      FROM parts),
    named AS (
      SELECT page_id, host, path, name, CASE WHEN len(masked) > {url_filter.DEPTH}
        THEN list_append(masked[1:{url_filter.DEPTH}], '**') ELSE masked END AS segments
      FROM segmented),
    good AS (
      SELECT doc_id::VARCHAR AS name, min(quality) AS good FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    t0 AS (
      SELECT host, segments, count(*) AS pages, coalesce(sum(good), 0) AS good,
             count(good) AS labels, '' AS template
      FROM named LEFT JOIN good ON good.name = named.name AND named.name <> ''
      GROUP BY host, segments),
    {"".join(_url_level(d) for d in range(url_filter.DEPTH + 1))}
    total AS (SELECT coalesce(sum(good) / nullif(sum(labels), 0)::DOUBLE, 1.0) AS prior FROM t0),
    verdicts AS (
      SELECT host, template, sum(good) AS good, sum(labels) AS labels,
             CASE WHEN (sum(good) + {url_filter.PRIOR} * any_value(prior))
               / (sum(labels) + {url_filter.PRIOR}) < {url_filter.LEAST_GOOD}
             THEN 'block' ELSE 'allow' END AS method
      FROM t{url_filter.DEPTH + 1}, total GROUP BY host, template),
    ruled AS (
      SELECT *, '.' || host AS dotted FROM named),
    chosen AS (
      SELECT page_id, host, path, segments, CASE
        WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/')
          THEN 'www.example.com/en/'
        WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM ruled)
    SELECT page_id, c.host, path, rule, template,
           CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                WHEN rule IS NOT NULL THEN 'block' ELSE method END AS verdict,
           v.good::BIGINT AS template_good, v.labels::BIGINT AS template_labels
    FROM chosen c JOIN t{url_filter.DEPTH + 1} t USING (host, segments)
    JOIN verdicts v USING (host, template)
    """
)
def op3_url_filter(spark, sf_dir):
    # the last number in a page's path is the document it shows
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("name"), F.col("quality").alias("good")
    )
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), labels)


@query(
    r"""
    WITH rows AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
      FROM documents),
    ranked AS (
      SELECT *, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM rows
      WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
    """
)
def op4_exact_dedup(spark, sf_dir):
    groups = exact_dedup.exact_groups(documents(spark, sf_dir))
    return groups.select(
        "doc_id", "keep_id", F.col("rows").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: The SQL of op8 reads so many trusted ids, of the smallest MD5; the operator reads all.
TRUSTED_IN_SQL = 20_000


@query(
    rf"""
    WITH RECURSIVE {CRC_TABLE},
    texts AS (
      SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
    alike AS (
      SELECT doc_id, strlen(text) + 1 AS size, {CRC} AS text_crc32 FROM texts, crc_table),
    numbered AS (
      SELECT *, coalesce(doc_id::VARCHAR, '~' || text_crc32) AS name,
             row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy
      FROM alike),
    rows AS (
      SELECT doc_id, size, text_crc32, ('0x' || substr(md5(
               CASE WHEN copy = 0 THEN name ELSE name || '#' || copy END), 1, 8))::BIGINT
               % {sharding.SLOTS} AS vslot
      FROM numbered),
    ranked AS (
      SELECT vslot, sum(size)::BIGINT AS slot_bytes, count(*) AS slot_rows,
             row_number() OVER (ORDER BY sum(size) DESC, vslot) AS turn
      FROM rows GROUP BY vslot),
    placed AS (
      SELECT 0::BIGINT AS turn, 0::BIGINT AS vslot, 0::BIGINT AS slot_rows, 0 AS shard,
             list_transform(range({sharding.SHARDS}), lambda x: 0::BIGINT) AS loads
      UNION ALL
      SELECT r.turn, r.vslot, r.slot_rows, list_position(p.loads, list_min(p.loads))::INTEGER - 1,
             list_transform(p.loads, lambda l, i: CASE
               WHEN i = list_position(p.loads, list_min(p.loads)) THEN l + r.slot_bytes ELSE l END)
      FROM placed p JOIN ranked r ON r.turn = p.turn + 1),
    starts AS (
      SELECT vslot, shard, coalesce(sum(slot_rows) OVER (PARTITION BY shard ORDER BY vslot
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot_start
      FROM placed WHERE turn > 0)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
           (slot_start + row_number() OVER (
             PARTITION BY vslot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
           NULL::INTEGER AS grown_shard, vslot
    FROM rows JOIN starts USING (vslot)
    """
)
def op5_sharding(spark, sf_dir):
    rows = sharding.shard_by_bytes(documents(spark, sf_dir), new_folder(spark, "slot-map"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


@query(
    rf"""
    WITH texts AS (
      SELECT doc_id, string_split(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls
      FROM documents),
    lines AS (
      SELECT doc_id, unnest(ls) AS body, unnest(range(len(ls))) AS line FROM texts),
    sets AS (
      SELECT doc_id, line,
             list_sort(list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) AS words
      FROM lines),
    classes AS (
      SELECT words, len(words) AS n, min({{'d': doc_id, 'l': line}}) AS first,
             row_number() OVER (ORDER BY min({{'d': doc_id, 'l': line}})) AS c
      FROM sets WHERE len(words) >= {line_dedup.LEAST_WORDS} GROUP BY words),
    tokens AS (SELECT c, n, unnest(words) AS w FROM classes),
    common AS (
      SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS k
      FROM tokens a JOIN tokens b ON a.w = b.w AND a.c < b.c
        AND least(a.n, b.n) * 100 >= {line_dedup.SIMILAR} * greatest(a.n, b.n)
      GROUP BY ALL),
    later AS (
      SELECT DISTINCT y FROM common
      WHERE k * {100 + line_dedup.SIMILAR} >= {line_dedup.SIMILAR} * (nx + ny)),
    gone AS (
      SELECT s.doc_id, s.line FROM sets s JOIN classes c USING (words)
      LEFT JOIN later ON later.y = c.c
      WHERE later.y IS NOT NULL OR c.first.d <> s.doc_id OR c.first.l <> s.line),
    listed AS (
      SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed
      FROM gone GROUP BY doc_id)
    SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
           coalesce(removed, '') AS removed
    FROM texts LEFT JOIN listed USING (doc_id)
    """
)
def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(documents(spark, sf_dir))


@query()
def op7_byte_bpe(spark, sf_dir):
    return bpe.encode_all(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query(
    rf"""
    WITH RECURSIVE {CRC_TABLE},
    texts AS (
      SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    vocabulary AS (
      SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT unnest(words) AS w FROM texts)),
    codes AS (SELECT w, {CRC} & {quality.BUCKETS - 1} AS code FROM vocabulary, crc_table),
    items AS (
      SELECT doc_id, i, code
      FROM (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM texts)
      JOIN codes USING (w)),
    features AS (
      SELECT doc_id, code AS bucket FROM items
      UNION ALL
      SELECT a.doc_id, (a.code * 31 + b.code) & {quality.BUCKETS - 1}
      FROM items a JOIN items b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
    trusted AS (
      SELECT doc_id, md5(doc_id::VARCHAR)[32] IN ('0', '4', '8', 'c') AS held_out
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
      HAVING min(quality) = 1 AND coalesce(max(toxic), 0) = 0
      ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED_IN_SQL}),
    counts AS (
      SELECT bucket, count(*) AS corpus, count(t.doc_id) AS target
      FROM features f LEFT JOIN trusted t ON t.doc_id = f.doc_id AND NOT held_out
      GROUP BY bucket),
    totals AS (SELECT sum(corpus)::DOUBLE AS c, sum(target)::DOUBLE AS t FROM counts),
    weights AS (
      SELECT bucket, round((ln((target + 1) / (t + {quality.BUCKETS}))
                            - ln((corpus + 1) / (c + {quality.BUCKETS}))) * {quality.UNITS})::BIGINT AS weight
      FROM counts, totals),
    scores AS (
      SELECT doc_id, sum(weight) AS llr, count(*) AS n_features
      FROM features JOIN weights USING (bucket) GROUP BY doc_id),
    windows AS (
      SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM texts)),
    doubled AS (
      SELECT doc_id, i FROM windows
      QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    repeated AS (
      SELECT doc_id, count(*) AS n FROM (
        SELECT DISTINCT doc_id, i + k AS place FROM doubled, range(5) r(k)) GROUP BY doc_id),
    lines AS (
      SELECT doc_id, list_filter(string_split(text, chr(10)),
               lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM texts),
    base AS (
      SELECT t.doc_id, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             coalesce(llr, 0)::BIGINT AS llr, coalesce(n_features, 0)::BIGINT AS n_features
      FROM texts t JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)
      LEFT JOIN scores s USING (doc_id)),
    least AS (
      SELECT floor(quantile_cont(floor(llr / n_features::DOUBLE), {quality.LOW_SHARE}))
             - {int(quality.UNITS * quality.MARGIN)} AS low
      FROM base JOIN trusted USING (doc_id) WHERE held_out AND n_words >= {quality.LEAST_WORDS})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, n_features,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
             AND llr >= n_features * low AS kept
    FROM base, least
    """
)
def op8_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@query()
def op9_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(
        documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    rf"""
    WITH templates AS (
      SELECT * FROM (VALUES {", ".join(
        f"({i}, {_quoted(name)}, {_quoted(text)})"
        for i, (name, text) in enumerate(licenses.TEMPLATES))}) v(template, license, body)),
    passages AS (
      SELECT doc_id, 'line' || i AS part, line AS body
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
            FROM documents WHERE text <> '')
      UNION ALL
      SELECT doc_id, 'text', text FROM documents WHERE contains(text, chr(10))
      UNION ALL
      SELECT doc_id, 'block' || i, block
      FROM (SELECT doc_id, unnest(bs) AS block, unnest(range(1, len(bs) + 1)) AS i
            FROM (SELECT doc_id, regexp_split_to_array(text, '\n(?:[ \t\r\f\x0B]*\n)+') AS bs
                  FROM documents) WHERE len(bs) > 1)),
    worded AS (
      SELECT 'p' AS side, doc_id, part, NULL AS license, list_filter(
        regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words
      FROM passages
      UNION ALL
      SELECT 't', template, '', license, list_filter(
        regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')
      FROM templates),
    paired AS (
      SELECT side, doc_id, part, license, CASE WHEN len(words) = 1 THEN words ELSE list_transform(
        range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END AS pairs
      FROM worded WHERE len(words) > 0),
    counted AS (
      SELECT side, doc_id, part, license, len(pairs) AS n, pair, count(*) AS c
      FROM (SELECT *, unnest(pairs) AS pair FROM paired) GROUP BY ALL),
    both_sides AS (
      SELECT p.doc_id, p.part, t.license, t.doc_id AS template, p.n + t.n AS total,
             sum(least(p.c, t.c)) AS k
      FROM counted p JOIN counted t ON p.pair = t.pair AND p.side = 'p' AND t.side = 't'
      GROUP BY ALL)
    SELECT doc_id, license, max(k * 2000000 // total)::BIGINT AS dice, count(*) AS passages
    FROM both_sides WHERE k * 200 >= total * {licenses.LEAST_DICE} GROUP BY doc_id, license
    """
)
def op10_license_scan(spark, sf_dir):
    return license_runs.license_scan(documents(spark, sf_dir))


@query()
def op11_token_alignment(spark, sf_dir):
    digests = alignment.align_digests(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    found = alignment.with_pair_sums(digests)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query()
def op12_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", language.held_out())
    model = language.learn(docs.where("doc_id is not null and not held_out"))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query(
    rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    counted AS (
      SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
      FROM (SELECT r, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
    kept AS (
      SELECT lang, term, sum(n) AS total FROM counted
      GROUP BY ALL HAVING sum(docs) >= {divergence.LEAST_DOCS}),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    grid AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total
      FROM groups g JOIN kept k USING (lang)
      LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sized AS (
      SELECT *, sum(n) OVER w + count(*) OVER w AS own, sum(total) OVER w + count(*) OVER w AS whole
      FROM grid WINDOW w AS (PARTITION BY lang, source)),
    rated AS (
      SELECT lang, source, term, n, 1 + {divergence.UNIT}::HUGEINT * (n + 1) // own AS p,
             1 + {divergence.UNIT}::HUGEINT * (total + 1) // whole AS q
      FROM sized),
    apart AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY ALL),
    valued AS (
      SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
      FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
      LEFT JOIN apart x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM rated WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (
            PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued)
    WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
    """
)
def op13_source_divergence(spark, sf_dir):
    return divergence.divergence(documents(spark, sf_dir))
