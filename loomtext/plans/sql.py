"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from loomtext.functions import lexicons as L


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def n_matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def n_literal(text: str, part: str) -> str:
    p = part.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{p}', ''))) // {len(part)})"


WORD = L.WORD.replace("'", "''")
WORDS = f"[lower(w) for w in regexp_extract_all(text, '{WORD}')]"
#: Sentence breaks without look-around: stop and first character are disjoint classes.
SENTENCES = r"""[trim(s, E' \n\t\r') for s in string_split(regexp_replace(trim(text, E' \n\t\r'), '([.!?])\s+(["''(A-Z0-9])', E'\\1\x01\\2', 'g'), E'\x01') if trim(s, E' \n\t\r') <> '']"""
PARAGRAPHS = r"[p for p in regexp_split_to_array(text, '\n\s*\n') if trim(p, E' \n\t\r') <> '']"


def distribution(lengths: str) -> str:
    """FROM (SELECT doc_id, s) with s the sorted list of positive lengths."""
    return f"""
        SELECT doc_id, len(s) AS n, list_avg(s) AS mean, list_median(s)::DOUBLE AS median, list_stddev_pop(s) AS stdev,
               s[greatest(0, len(s) // 10 - 1) + 1]::DOUBLE AS p10, s[least(len(s) - 1, len(s) * 9 // 10) + 1]::DOUBLE AS p90,
               s[1]::DOUBLE AS low, s[len(s)]::DOUBLE AS high
        FROM (SELECT doc_id, list_sort([n for n in [len(regexp_extract_all(x, '{WORD}')) for x in {lengths}] if n > 0]) AS s FROM documents)"""


def share_of(words: str, members) -> str:
    return f"len([w for w in {words} if w in ({quoted(members)})])"


def lexicon() -> str:
    rows = ", ".join(f"('{k}', '{v}', {i}, {str(k in L.AMBIGUOUS).lower()})" for i, (k, v) in enumerate(L.LIGATURES.items()))
    return f"(VALUES {rows}) lexicon(bad, good, position, ambiguous)"
