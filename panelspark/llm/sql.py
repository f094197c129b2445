"""DuckDB twins of the queries, built from the same parameters."""

from __future__ import annotations

from panelspark.llm.fill_middle import FimRule
from panelspark.llm.hash_tree import shard_tree
from panelspark.llm.mixture import OFFSETS, MixRule
from panelspark.llm.quality import QualityRules


def _quality(rules: QualityRules = QualityRules()) -> str:
    signals = " UNION ALL ".join(
        f"SELECT rid, lang, source, '{s}' AS signal, {top} * 1000 // greatest({bottom}, 1) AS v FROM counts WHERE NOT base_failed"
        for s, (top, bottom, _) in rules.signals.items())
    quartiles = """
        SELECT {keys} signal, max(total) AS rows, min(CASE WHEN upto * 4 >= total THEN lb END) AS q1,
               min(CASE WHEN upto * 4 >= total * 3 THEN lb END) AS q3
        FROM (SELECT {keys} signal, lb, sum(n) OVER (PARTITION BY {keys} signal) AS total,
                     sum(n) OVER (PARTITION BY {keys} signal ORDER BY b) AS upto
              FROM (SELECT {keys} signal, b, lb, sum(n) AS n FROM sketch GROUP BY ALL))
        GROUP BY ALL"""
    slack = " ".join(f"WHEN '{s}' THEN {x[2]}" for s, x in rules.signals.items())
    two_sided = ", ".join(f"'{s}'" for s in rules.two_sided)
    return rf"""
    WITH base AS (
        SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    words AS (
        SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
    triples AS (
        SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
    often AS (SELECT rid, i FROM triples QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
    repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY rid),
    raw AS (
        SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
               length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
               len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
               length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts
        FROM words LEFT JOIN repeats USING (rid)),
    counts AS (
        SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM raw),
    vals AS ({signals}),
    buckets AS (
        SELECT *, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 16 + (v >> (length(bin(v)) - 5)) - 16 END AS b FROM vals),
    sketch AS (
        SELECT lang, source, signal, b, CASE WHEN b < 16 THEN b ELSE (b % 16 + 16) << (b // 16 - 1) END AS lb, count(*) AS n
        FROM buckets GROUP BY ALL),
    q2 AS ({quartiles.format(keys="lang, source,")}),
    q1 AS ({quartiles.format(keys="lang,")}),
    q0 AS ({quartiles.format(keys="")}),
    chosen AS (
        SELECT q2.lang, q2.source, q2.signal,
               CASE WHEN q2.rows >= {rules.least} THEN q2.q1 WHEN q1.rows >= {rules.least} THEN q1.q1 ELSE q0.q1 END AS lo,
               CASE WHEN q2.rows >= {rules.least} THEN q2.q3 WHEN q1.rows >= {rules.least} THEN q1.q3 ELSE q0.q3 END AS hi
        FROM q2 JOIN q1 ON q2.signal = q1.signal AND q2.lang IS NOT DISTINCT FROM q1.lang JOIN q0 ON q2.signal = q0.signal),
    limits AS (
        SELECT *, greatest((hi - lo) * {rules.spread}, CASE signal {slack} END) AS width FROM chosen),
    bad AS (
        SELECT DISTINCT rid FROM vals JOIN limits ON vals.signal = limits.signal AND vals.lang IS NOT DISTINCT FROM limits.lang
            AND vals.source IS NOT DISTINCT FROM limits.source
        WHERE v > hi + width OR (vals.signal IN ({two_sided}) AND v < lo - width))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept
    FROM counts"""


QUALITY = _quality()

URLS = r"""
    WITH parts AS (
        SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS r FROM pages),
    p AS (
        SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    ruled AS (
        SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                       WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                       WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                       WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN regexp_matches(host, 'casino|pills|adult|free-bets|spam|(^|\.)ads-')
                  OR regexp_matches(path, '/wp-login[^/]*$|/wp-admin/|/cgi-bin/')
                  OR regexp_matches(host || path, '\.(exe|apk)$') THEN 'block'
                ELSE 'allow' END AS verdict
    FROM ruled"""


def _winner(groups: dict[str, tuple[float, str]]) -> str:
    """CASE that picks the value of the child with the least draw."""
    if len(groups) == 1:
        return next(iter(groups.values()))[1]
    draws = {n: f"(-ln((('0x' || substr(md5(id || '|{n}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {float(w)})"
             for n, (w, _) in groups.items()}
    least = f"least({', '.join(draws.values())})"
    return "(CASE " + " ".join(f"WHEN {d} = {least} THEN {groups[n][1]}" for n, d in draws.items()) + " END)"


def _tree(shards: int) -> str:
    regions: dict[str, dict[str, dict[str, tuple[float, str]]]] = {}
    for leaf in shard_tree(shards):
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[f"s{leaf.shard}"] = (leaf.weight, str(leaf.shard))
    total = lambda x: x[0] if isinstance(x, tuple) else sum(map(total, x.values()))
    return _winner({r: (total(racks), _winner({k: (total(leaves), _winner(leaves)) for k, leaves in racks.items()}))
                    for r, racks in regions.items()})


SHARDS = f"""
    WITH crc AS (  -- the CRC-32 of each byte value
        SELECT list_transform(range(256), lambda i: list_reduce(range(8),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
    body AS (
        SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    base AS (
        SELECT doc_id, id, (length(h) // 2 + 1)::BIGINT AS size,
               xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))::BIGINT AS text_crc32
        FROM body, crc),
    placed AS (
        SELECT *, ({_tree(16)})::INTEGER AS shard, ({_tree(17)})::INTEGER AS grown_shard FROM base)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY md5(id || '|' || size || '|' || text_crc32), doc_id) - 1 AS slot, grown_shard
    FROM placed"""


def _fill_middle(r: FimRule = FimRule()) -> str:
    draw = [f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
    return rf"""
    WITH base AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('{r.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
    drawn AS (SELECT *, len(u)::BIGINT AS n, {draw[0]} % (len(u) + 1) AS a, {draw[1]} % (len(u) + 1) AS b FROM base),
    parts AS (
        SELECT doc_id, t, n, array_to_string(u[:least(a, b)], '') AS p,
               array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
               CASE WHEN t = '' OR contains(t, '{r.prefix}') OR contains(t, '{r.suffix}') OR contains(t, '{r.middle}')
                      OR {draw[2]} % 100 >= {r.percent} THEN 'plain'
                    WHEN {draw[3]} % 100 < {r.spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{r.prefix}' || p || '{r.suffix}' || s || '{r.middle}' || m
                  ELSE '{r.suffix}' || s || '{r.prefix}' || p || '{r.middle}' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts"""


FILL_MIDDLE = _fill_middle()


def _mixture(r: MixRule = MixRule()) -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(r.weights))
    return rf"""
    WITH sized AS (
        SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS key,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    classed AS (
        SELECT *, CASE WHEN size < 16 THEN size ELSE (length(bin(size)) - 4) * 16 + (size >> (length(bin(size)) - 5)) - 16 END AS class
        FROM sized),
    placed AS (
        SELECT *, (row_number() OVER (PARTITION BY key ORDER BY class,
            md5('{r.seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || size), doc_id NULLS FIRST, size) - 1)::HUGEINT AS place FROM classed),
    sources AS (SELECT key, sum(size)::HUGEINT AS size FROM sized GROUP BY key),
    weighed AS (
        SELECT *, (CASE (row_number() OVER (ORDER BY key) - 1) % {len(r.weights)} {weights} END)::HUGEINT AS w,
               sum(size) OVER ()::HUGEINT AS total FROM sources),
    levels AS (
        SELECT *, coalesce(sum(size) OVER before, 0)::HUGEINT AS full_before,
               (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::HUGEINT AS open_from FROM weighed
        WINDOW before AS (ORDER BY size * {_product(r.weights)} // w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    judged AS (
        SELECT *, {100 * r.most} * size * open_from < w * ({r.percent} * total - {100 * r.most} * full_before) AS is_full FROM levels),
    shared AS (
        SELECT *, coalesce(sum(CASE WHEN is_full THEN size END) OVER (), 0)::HUGEINT AS sated,
               coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (), 0)::HUGEINT AS open_w FROM judged),
    targets AS (
        SELECT key, size, CASE WHEN is_full THEN {100 * r.most} * size ELSE w * ({r.percent} * total - {100 * r.most} * sated) END AS num,
               CASE WHEN is_full THEN 100 ELSE 100 * open_w END AS part,
               ('0x' || substr(md5('{r.seed}|' || key), 1, 5))::HUGEINT AS k FROM shared)
    SELECT doc_id, p.size, t.size::BIGINT AS source_size, num::DOUBLE / part::DOUBLE AS target,
           (CASE WHEN t.size = 0 THEN 0 ELSE
               ((place + 1) * num * {OFFSETS} + k * part * t.size) // (part * t.size * {OFFSETS})
               - (place * num * {OFFSETS} + k * part * t.size) // (part * t.size * {OFFSETS}) END * p.size)::BIGINT AS taken
    FROM placed p JOIN targets t ON p.key = t.key"""


def _product(values) -> int:
    out = 1
    for v in values:
        out *= v
    return out


MIXTURE = _mixture()
