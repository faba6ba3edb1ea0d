"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import MIX_EPOCHS, MIX_FRACTION, MIX_SEED, WEIGHTS

#: Words of a text, as in the operators.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS escaped,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS escaped_role
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ') + escaped_role + 1 + escaped + length('</turn>'))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END) AS turn_order_valid
FROM sized GROUP BY conv_id
"""


def _weight(level: tuple[str, ...]) -> str:
    """CASE over the given weights of one level; 1 where none is given."""
    cases = "".join(
        f" WHEN {' AND '.join(f'{c} = {chr(39)}{v}{chr(39)}' for c, v in zip(level, path, strict=True))} THEN {float(w)}"
        for path, w in WEIGHTS.items()
        if len(path) == len(level)
    )
    return f"CASE{cases} ELSE 1.0 END::DOUBLE"


def _mix() -> str:
    tree = ("d", "l", "s")
    parts = [
        f"""rows AS (
  SELECT doc_id, lang, source, text,
    CASE WHEN n = '' OR n IS NULL THEN 'other' WHEN n::INT = 0 THEN 'web' WHEN n::INT < 10 THEN 'news' ELSE 'books' END AS d,
    coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s, len({_WORDS}) AS tokens
  FROM (SELECT *, regexp_extract(source, '(\\d{{1,6}})$', 1) AS n FROM documents)
), leaves AS (SELECT d, l, s, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL),
level0 AS (SELECT least(floor(sum(tokens) * {MIX_FRACTION}), floor(sum(tokens) * {MIX_EPOCHS})) AS share FROM leaves)"""
    ]
    for k in range(1, 4):
        path = ", ".join(tree[:k])
        parent = ", ".join(tree[: k - 1])
        by = f"PARTITION BY {parent}" if parent else ""
        weighed = f"SELECT {path}, {_weight(tree[:k])} AS weight, sum(tokens) * {MIX_EPOCHS} AS cap FROM leaves GROUP BY {path}"
        capped = f"SELECT {path}, weight, CASE WHEN weight > 0 THEN cap ELSE 0 END AS cap, CASE WHEN weight > 0 THEN cap / weight ELSE 0 END AS ratio FROM ({weighed})"
        joined = f"SELECT c.*, p.share AS above FROM ({capped}) c " + (f"JOIN level{k - 1} p USING ({parent})" if parent else "CROSS JOIN level0 p")
        parts.append(
            f"""water{k} AS (
  SELECT *, (above - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS water
  FROM ({joined}) WINDOW o AS ({by} ORDER BY ratio, {tree[k - 1]})
), level{k} AS (
  SELECT {path}, CASE WHEN cap <= water * weight THEN cap ELSE greatest(0, coalesce(
    max(CASE WHEN NOT (cap <= water * weight) THEN water END) OVER ({by}), 0) * weight) END AS share FROM water{k}
)"""
        )
    parts.append(
        f"""plan AS (
  SELECT d, l, s, CASE WHEN tokens > 0 THEN (floor(share)::BIGINT // tokens::BIGINT) ELSE 0 END AS epochs, floor(share)::BIGINT AS budget, tokens::BIGINT AS leaf
  FROM level3 JOIN leaves USING (d, l, s)
), seeded AS (
  SELECT *, md5('{MIX_SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM rows JOIN plan USING (d, l, s)
)
SELECT doc_id, d AS domain, lang, source, tokens::BIGINT AS n_tokens,
  (epochs + CASE WHEN sum(tokens) OVER (PARTITION BY d, l, s ORDER BY h, doc_id NULLS FIRST) <= budget - epochs * leaf THEN 1 ELSE 0 END)::BIGINT AS copies
FROM seeded"""
    )
    return "WITH " + ",\n".join(parts)


SQL: dict[str, str] = {"op9_chat_format": _CHAT, "op6_source_mixing": _mix()}
