"""Standard SQL for the training-data queries that SQL can express."""

#: Unsigned crc32 of the decimal doc_id, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _leaf(text: str) -> str:
    shown = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(shown)})"


def _levels(name: str, depth: int) -> list[str]:
    """From {name}0 (g, idx, n, h): a level's siblings in {name}_sib, the next level's nodes in {name}."""
    out = []
    for k in range(depth):
        run = "PARTITION BY g, idx // 3 ORDER BY idx ROWS BETWEEN"
        out += [
            f"{name}_sib{k} AS MATERIALIZED (SELECT g, idx, n, string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pre,"
            f" coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k} WHERE n > 1)",
            f"{name}{k + 1} AS MATERIALIZED (SELECT g, idx // 3 AS idx, (n + 2) // 3 AS n, sha256(pre) AS h FROM {name}_sib{k} WHERE idx % 3 = 0)",
        ]
    return out


def _folds(name: str, tree: str, depth: int) -> list[str]:
    return [
        f"{name}{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.idx // 3 AS idx, CASE WHEN s.g IS NULL THEN acc ELSE sha256(before || acc || after) END AS acc, proof || coalesce(before || after, '') AS proof)"
        f" FROM {name}{k} f LEFT JOIN {tree}_sib{k} s ON s.g = f.g AND s.idx = f.idx)"
        for k in range(depth)
    ]


def merkle(depth: int = 10, groups: int = 5) -> str:
    """For sources of at most 3^depth documents and 3^groups sources."""
    parts = [
        f"leaves AS MATERIALIZED (SELECT doc_id, source, {_leaf('text')} AS h, {_leaf('checked_text')} AS checked FROM (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS checked_text FROM documents))",
        "a0 AS MATERIALIZED (SELECT coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, h, doc_id, checked FROM leaves)",
        *_levels("a", depth),
        "tops AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(depth + 1)) + ")",
        "b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, h, g AS source_key FROM tops)",
        *_levels("b", groups),
        "top AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE n = 1" for k in range(groups + 1)) + ")",
        "f0 AS (SELECT g, idx, doc_id, h AS leaf, checked AS acc, '' AS proof FROM a0)",
        *_folds("f", "a", depth),
        f"e0 AS (SELECT b.g, b.idx, doc_id, leaf, b.h AS subroot, acc, proof FROM f{depth} f JOIN b0 b ON b.source_key = f.g)",
        *_folds("e", "b", groups),
    ]
    return f"WITH {', '.join(parts)}\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM e{groups}, top"


#: Scores of all documents that share a term with an item.
LEXICAL = r"""
WITH lowered AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tf AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM lowered) GROUP BY row, doc_id, term),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM (SELECT row, any_value(n) AS n FROM tf GROUP BY row)),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term), whole GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""


def near_sets(width: int = 4, percent: int = 80, rounds: int = 24) -> str:
    """Sets of shingles, links through shared ones, and the least id reached in so many rounds of steps and
    jumps (a path of 2^rounds links at most)."""
    shingle = " || ' ' || ".join(f"words[i + {k}]" if k else "words[i]" for k in range(width))
    reach = ["m0 AS MATERIALIZED (SELECT k AS a, k AS b FROM sets)"]
    for r in range(rounds):
        reach.append(f"m{r + 1} AS MATERIALIZED (SELECT s.a, least(min(s.b), min(j.b)) AS b FROM (SELECT m.a, least(m.b, coalesce(min(n.b), m.b)) AS b FROM m{r} m LEFT JOIN both_ways w ON w.x = m.a LEFT JOIN m{r} n ON n.a = w.y GROUP BY m.a, m.b) s JOIN m{r} j ON j.a = s.b GROUP BY s.a)")
    return rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
own AS MATERIALIZED (SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {width - 2}), lambda i: {shingle}))) END AS shingles FROM split),
sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS k, shingles, len(shingles) AS n, min(doc_id) AS first FROM own WHERE len(shingles) > 0 GROUP BY shingles),
flat AS MATERIALIZED (SELECT k, n, hash(unnest(shingles)) AS g FROM sets),
common AS (SELECT a.k AS x, b.k AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.k < b.k AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY a.k, b.k),
linked AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * c >= {percent} * (total - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
{", ".join(reach)},
found AS (SELECT s.shingles, f.first AS component FROM sets s JOIN m{rounds} m ON m.a = s.k JOIN sets f ON f.k = m.b)
SELECT doc_id, CAST(len(o.shingles) AS BIGINT) AS n_shingles, CASE WHEN len(o.shingles) > 0 THEN component ELSE doc_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(o.shingles) > 0 THEN component ELSE doc_id END AS kept
FROM own o LEFT JOIN found f ON f.shingles = o.shingles"""
