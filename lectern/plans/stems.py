"""Porter's stemmer as SQL, for the oracle of stemmed search: each step is a
common table expression over (term, w), with a word's shape as a string of V
and C in place of a measure counted letter by letter."""

from __future__ import annotations

from ..functions.stemming import STEP2, STEP3, STEP4


def _shape(w: str) -> str:
    """V for vowels and for y after a consonant, C for all other characters,
    two for one beyond ASCII. Letters are marked by signs first, since v and c
    are letters too."""
    marked = f"regexp_replace(regexp_replace(regexp_replace({w}, '[^\\x00-\\x7F]', '--', 'g'), '[aeiou]', '+', 'g'), '[^+y-]', '-', 'g')"
    for _ in range(3):  # y counts from left to right: each pass settles the first y of a run
        marked = f"regexp_replace(regexp_replace(regexp_replace({marked}, '^y', '-'), '[+]y', '+-', 'g'), '-y', '-+', 'g')"
    return f"replace(replace({marked}, '+', 'V'), '-', 'C')"


def _m(cut: int, shape: str = "s") -> str:
    return f"len(regexp_extract_all(left({shape}, length({shape}) - {cut}), 'V+C+'))"


def _suffixes(table: dict[str, str], more: str) -> str:
    cases = " ".join(f"WHEN ends_with(w, '{x}') THEN CASE WHEN {_m(len(x))} {more} THEN left(w, length(w) - {len(x)}) || '{y}' ELSE w END" for x, y in sorted(table.items(), key=lambda p: -len(p[0])))
    return f"CASE {cases} ELSE w END"


def _double(w: str) -> str:
    return f"length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1) AND right({_shape(w)}, 1) = 'C'"


def _short(w: str, shape: str) -> str:
    return f"length({w}) > 2 AND right({shape}, 3) = 'CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y')"


def porter(source: str, name: str) -> str:
    """Tables that end in name(term, stem), from source(term, w): w is what is
    stemmed, the folded term."""
    out, before = [], source

    def step(k: str, w: str) -> None:
        nonlocal before
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT term, w0, w, {_shape('w')} AS s FROM (SELECT term, w0, {w} AS w FROM {before}))")
        before = f"{name}_{k}"

    out.append(f"{name}_0 AS (SELECT term, w AS w0, w, {_shape('w')} AS s FROM {source} WHERE strlen(w) BETWEEN 3 AND 64)")
    before = f"{name}_0"
    step("1a", "CASE WHEN (ends_with(w, 'sses') OR ends_with(w, 'ies')) AND strlen(w) > 3 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END")
    ending = "CASE WHEN ends_with(w, 'eed') AND strlen(w) > 3 THEN '' WHEN ends_with(w, 'ed') AND contains(left(s, length(s) - 2), 'V') THEN 'ed' WHEN ends_with(w, 'ing') AND contains(left(s, length(s) - 3), 'V') THEN 'ing' ELSE '' END"
    out.append(f"{name}_1x AS MATERIALIZED (SELECT term, w0, w, s, e, left(w, length(w) - length(e)) AS v FROM (SELECT *, {ending} AS e FROM {before}))")
    before = f"{name}_1x"
    sv = _shape("v")
    step("1b", f"""CASE WHEN ends_with(w, 'eed') AND strlen(w) > 3 THEN CASE WHEN {_m(3)} > 0 THEN left(w, length(w) - 1) ELSE w END WHEN e = '' THEN w
      WHEN ends_with(v, 'at') OR ends_with(v, 'bl') OR ends_with(v, 'iz') THEN v || 'e' WHEN {_double('v')} AND right(v, 1) NOT IN ('l', 's', 'z') THEN left(v, length(v) - 1)
      WHEN {_double('v')} THEN v WHEN {_m(0, sv)} = 1 AND {_short('v', sv)} THEN v || 'e' ELSE v END""")
    step("1c", "CASE WHEN ends_with(w, 'y') AND contains(left(s, length(s) - 1), 'V') THEN left(w, length(w) - 1) || 'i' ELSE w END")
    step("2", _suffixes(STEP2, "> 0"))
    step("3", _suffixes(STEP3, "> 0"))
    fourth = " ".join(
        f"WHEN ends_with(w, '{x}') THEN CASE WHEN {_m(len(x))} > 1{' AND left(right(w, 4), 1) IN (' + chr(39) + 's' + chr(39) + ', ' + chr(39) + 't' + chr(39) + ')' if x == 'ion' else ''} THEN left(w, length(w) - {len(x)}) ELSE w END"
        for x in sorted(STEP4, key=len, reverse=True)
    )
    step("4", f"CASE {fourth} ELSE w END")
    short = _short("left(w, length(w) - 1)", "left(s, length(s) - 1)")
    step("5a", f"CASE WHEN ends_with(w, 'e') AND ({_m(1)} > 1 OR ({_m(1)} = 1 AND NOT ({short}))) THEN left(w, length(w) - 1) ELSE w END")
    step("5b", f"CASE WHEN ends_with(w, 'll') AND {_m(1)} > 1 THEN left(w, length(w) - 1) ELSE w END")
    out.append(f"{name} AS MATERIALIZED (SELECT term, w AS stem FROM {before} UNION ALL SELECT term, w FROM {source} WHERE NOT strlen(w) BETWEEN 3 AND 64)")
    return ",\n".join(out)
