"""Line-first quality rules: lines that fail are removed, and a document that loses too much text is rejected.

Words are runs of anything but ASCII white space. A line with a word fails if it is
 - mostly marks (punctuation rule): over `max_marks` percent of its word bytes are one of ``#*$%&|<>!~=_^``;
 - without an end (punctuation rule): fewer than `end_words` words, the last of which doesn't end in one of ENDS;
 - a menu (navigation rule): two separators ``|`` or more that stand as words, with four or fewer words to each part;
 - boilerplate: at most `boilerplate_words` words and one of BOILERPLATE in it, or equal to an earlier line.

Defined results: null or empty text has no words and is rejected by the base rule; a very long text is read whole;
repeated rows each give a row; an empty table gives an empty one; columns of the input that share a name with a result
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import as_bytes, map_text

SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!~=_^"
#: What a sentence or its quotation may end in, in several scripts.
ENDS = tuple(".!?…:;\"')]»”’。！？：；」』।؟۔")
#: Phrases of lines that are not the document's own: English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved", "released under the", "licensed under", "spdx-license-identifier", "copyright (c)",
    "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "sign up for our newsletter",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "activer javascript",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "activar javascript",
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_marks: int = 15
    end_words: int = 10
    boilerplate_words: int = 20
    max_lost_pct: int = 50


FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("n_failed_lines", T.LongType()),
    ("lost_bytes", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    first: dict = {}
    if len(set(windows)) == n:
        return 0
    again = set()
    for w in windows:
        if w in first:
            again.add(w)
        else:
            first[w] = None
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def evaluator(rules: QualityRules) -> Callable[[bytes], tuple]:
    """The columns FIELDS of a text, and after them the lines it keeps (those without a word among them)."""
    boiler = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
    ends = tuple(e.encode() for e in ENDS)

    def line_fails(line: bytes, words: list[bytes], size: int) -> bool:
        if len(words) < rules.end_words and not words[-1].endswith(ends):
            return True
        marks = len(line) - len(line.translate(None, MARKS))
        if marks:
            if 100 * marks > rules.max_marks * size:
                return True
            bars = words.count(b"|")
            if bars >= 2 and len(words) - bars <= 4 * (bars + 1):
                return True
        if len(words) > rules.boilerplate_words:
            return False
        return boiler.search(line.lower() if line.isascii() else line.decode().lower().encode()) is not None

    def run(text: bytes) -> tuple:
        words = text.split()
        total = sum(map(len, words))
        seen: set[bytes] = set()
        dup = failed = lost = 0
        rest: list[bytes] = []
        for line in text.split(b"\n"):
            own = line.split()
            if not own:
                rest.append(line)
                continue
            size = sum(map(len, own))
            if line in seen:
                dup += 1
                bad = True
            else:
                seen.add(line)
                bad = line_fails(line, own, size)
            if bad:
                failed += 1
                lost += size
            else:
                rest.append(line)
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        again = repeat_words(words)
        base = len(words) < rules.min_words or 100 * again > rules.max_repeat_pct * len(words)
        kept = not base and 100 * lost <= rules.max_lost_pct * total
        return len(words), len(text) - total, symbols, dup, again, failed, lost, base, kept, rest

    return run


def clean_text(text: str, rules: QualityRules | None = None) -> str:
    """The lines that pass, as the operator judges them."""
    return b"\n".join(evaluator(rules or QualityRules())(text.encode())[-1]).decode()


def evaluate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: QualityRules | None = None, cleaned: str | None = None) -> DataFrame:
    """The counts and the verdict of each document beside its `keep` columns; with `cleaned`, a column of that name holds the
    lines that pass (null where the document is rejected)."""
    rules = rules or QualityRules()

    def make() -> Callable[[pa.Array], list]:
        one = evaluator(rules)

        def run(col: pa.Array) -> list:
            cols: list[list] = [[] for _ in FIELDS]
            texts: list[str | None] = []
            for b in as_bytes(col):
                *found, rest = one(b)
                for to, x in zip(cols, found, strict=True):
                    to.append(x)
                if cleaned:
                    texts.append(b"\n".join(rest).decode() if found[-1] else None)
            out = [pa.array(c, pa.bool_() if t == T.BooleanType() else pa.int64()) for c, (_, t) in zip(cols, FIELDS, strict=True)]
            points = pc.cast(pc.fill_null(pc.utf8_length(col), 0), pa.int64())
            out[1] = pc.subtract(points, out[1])  # code points less white space
            return [*out, pa.array(texts, pa.string())] if cleaned else out

        return run

    return map_text(docs, make, FIELDS + [(cleaned, T.StringType())] * bool(cleaned), list(keep))


#: DuckDB SQL over `documents` for the same rows.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
l1 AS (SELECT rid, ln, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l0),
l2 AS (SELECT rid, ln, line, lw, len(lw) AS lnw, strlen(array_to_string(lw, '')) AS size,
              strlen(line) - strlen(regexp_replace(line, '[#*$%&|<>!~=_^]', '', 'g')) AS marks,
              len(list_filter(lw, lambda x: x = '|')) AS bars,
              row_number() OVER (PARTITION BY rid, line ORDER BY ln) > 1 AS dup
       FROM l1 WHERE len(lw) > 0),
l3 AS (SELECT *, dup OR (lnw < 10 AND NOT regexp_matches(lw[-1], '[.!?…:;"'')\]»”’。！？：；」』।؟۔]$')) OR 100 * marks > 15 * size OR (bars >= 2 AND lnw - bars <= 4 * (bars + 1))
              OR (lnw <= 20 AND regexp_matches(lower(line),
   'all rights reserved|released under the|licensed under|spdx-license-identifier|copyright \(c\)|cookie policy|privacy policy|terms of use|terms of service|enable javascript|sign up for our newsletter|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|javascript aktivieren|newsletter abonnieren|tous droits réservés|politique de confidentialité|mentions légales|conditions d''utilisation|activer javascript|todos los derechos reservados|política de privacidad|aviso legal|términos de uso|activar javascript')) AS bad
       FROM l2),
lines AS (SELECT rid, sum(CASE WHEN dup THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS n_failed_lines,
                 sum(CASE WHEN bad THEN size ELSE 0 END) AS lost_bytes FROM l3 GROUP BY rid),
u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
t0 AS (SELECT rid, i, x, lead(x) OVER (PARTITION BY rid ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) AS z FROM u),
t1 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM t0 WHERE z IS NOT NULL),
rep AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + k AS p FROM t1, (VALUES (0), (1), (2)) v(k) WHERE n > 1) q GROUP BY rid),
b AS (SELECT d.doc_id, d.rid, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
             strlen(array_to_string(w.ws, '')) AS word_bytes,
             CAST(strlen(d.text) - strlen(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost_bytes, 0) AS BIGINT) AS lost_bytes
      FROM d JOIN w ON d.rid = w.rid LEFT JOIN lines ON d.rid = lines.rid LEFT JOIN rep ON d.rid = rep.rid),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_bytes, base_failed,
       NOT base_failed AND 100 * lost_bytes <= 50 * word_bytes AS kept FROM c
"""
