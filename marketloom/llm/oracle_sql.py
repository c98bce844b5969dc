"""DuckDB SQL for the rows of queries whose text is too long to stand beside them."""

from __future__ import annotations

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(crc, b)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all({text}, '.'), lambda ch: ascii(ch)::BIGINT), lambda crc, b: {bits}), 4294967295)"


def merkle(arity: int = 16) -> str:
    """Levels as recursive groupings, then every leaf walks to its subroot and on to the root."""

    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256(concat({', '.join(fields)}))"

    others = f"parts[1 : idx % {arity}] || {{}}parts[idx % {arity} + 2 :]"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(_LOWERED.format('text'))} END AS altered FROM documents
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM numbered
  UNION ALL
  SELECT tree, level + 1, idx // {arity}, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + {arity - 1}) // {arity} FROM nodes WHERE n > 1 GROUP BY tree, level, idx // {arity}
), subroots AS (
  SELECT tree, digest AS subroot FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree - 1 AS idx, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // {arity}, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + {arity - 1}) // {arity} FROM tops WHERE n > 1 GROUP BY level, idx // {arity}
), runs AS (
  SELECT tree, level, idx // {arity} AS run, list(digest ORDER BY idx) AS parts FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 0, level, idx // {arity}, list(digest ORDER BY idx) FROM tops WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT tree, max(level), 0, NULL FROM nodes GROUP BY tree
), walk AS (
  SELECT tree, idx AS leaf_idx, tree AS now, 0 AS level, idx, coalesce(altered, leaf) AS acc, '' AS proof FROM numbered
  UNION ALL
  SELECT w.tree, leaf_idx, if(parts IS NULL, 0, now), if(parts IS NULL, 0, w.level + 1), if(parts IS NULL, w.tree - 1, idx // {arity}),
         if(parts IS NULL, acc, sha256(array_to_string({others.format('[acc] || ')}, ''))), if(parts IS NULL, proof, proof || array_to_string({others.format('')}, ''))
  FROM walk w JOIN runs r ON r.tree = now AND r.level = w.level AND r.run = idx // {arity}
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM numbered JOIN subroots USING (tree) JOIN (SELECT digest AS root FROM tops WHERE n = 1) ON true
JOIN (SELECT tree, leaf_idx AS idx, acc, proof FROM walk WHERE now = 0 AND level = (SELECT max(level) FROM tops)) USING (tree, idx)"""


def conversation_repair() -> str:
    """Forward over the turns: per state the cheapest list of edits, then the ASCII-least, with what it leaves said."""

    def grown(b: str, cost: str, letter: str, said: str = "") -> str:
        return f"CASE WHEN {b} IS NOT NULL THEN {{'cost': {b}.cost + {cost}, 'audit': {b}.audit || '{letter}', 'said': {b}.said{f' || [{said}]' if said else ''}}} END"

    def kept(b: str, initial: str) -> str:
        return f"CASE WHEN free AND r = '{initial}' THEN {grown(b, 'stays', 'K', "role || ':' || text")} END"

    def retitled(b: str, name: str) -> str:
        return f"CASE WHEN free THEN {grown(b, 'stays + 1', 'R', f"'{name}:' || text")} END"

    def inserted(b: str, name: str) -> str:
        return grown(b, "5", "I", f"'{name}:'")

    def with_inserts(source: str) -> str:
        for _ in range(2):
            source = f"SELECT conv, i, b0, b1, least(b2, {', '.join(inserted(b, 'user') for b in ('b0', 'b1', 'b3'))}) AS b2, b3 FROM ({source})"
            source = f"SELECT conv, i, b0, b1, b2, least(b3, {inserted('b2', 'assistant')}) AS b3 FROM ({source})"
        return source

    deleted = [grown(f"b{s}", "2", "D") for s in range(4)]
    user = [f(b, x) for b in ("b0", "b1", "b3") for f, x in ((kept, "u"), (retitled, "user"))]
    stepped = f"""SELECT conv, i, {deleted[0]} AS b0, least({deleted[1]}, {kept('b0', 's')}) AS b1, least({deleted[2]}, {', '.join(user)}) AS b2,
      least({deleted[3]}, {kept('b2', 'a')}, {retitled('b2', 'assistant')}) AS b3
      FROM (SELECT best.conv, t.i, b0, b1, b2, b3, r, role, text, fault IN ('', 'truncated') AS free, if(fault = 'truncated', 5, 0) AS stays
            FROM best JOIN told t ON t.conv = best.conv AND t.i = best.i + 1)"""
    none = "CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]))"
    first = f"SELECT conv, 0::BIGINT AS i, {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM ids"
    numbers = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    return f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS planted FROM conversations
), ids AS (
  SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), damaged AS (
  SELECT conv, turn, if(planted = 4, 'user', role) AS role, CASE planted WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(if(planted = 3, 2, 1)))
  FROM given JOIN ids ON given.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE planted <> 0
), placed AS (
  SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, {_WHITE}) AS body FROM damaged
), told AS (
  SELECT *, role[1] AS r, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal,
         CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), best AS (
  {with_inserts(first)}
  UNION ALL
  {with_inserts(stepped)}
), counts AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM told GROUP BY conv
)
SELECT conv_id, {numbers}, least(b0, b3).cost AS cost, least(b0, b3).audit AS audit, sha256(array_to_string(least(b0, b3).said, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN counts USING (conv) JOIN best ON best.conv = ids.conv AND best.i = coalesce(n, 0)"""
