"""Secret scan: three base patterns, and sliding-window entropy over candidate strings.

Spans are code points, end exclusive. The base kinds are ``assign`` (a keyword, ``:`` or ``=``, and a
value of 12 or more characters), ``access`` (``AKIA...``, 18 or more) and ``hex`` (16 or more).
``entropy`` spans are added to them: a candidate is a maximal run over the characters of a class, and
while a window slides along it one count goes up and one down; the span reaches from the first to the
last window whose Shannon entropy is at or above the class's threshold. A candidate of ``SHORT`` or more
characters that is shorter than the window is one window, with the threshold in the same proportion to the most
its length allows; it is named unless a base span holds it already. Candidates that match an anchored allow-list
pattern as a whole, and spans that hold one of the others, are passed over; so are spans that look like words or
plain numbers. Words have no digits, and beside words in one case or capitalised the rarer case has at most a fifth of
the letters, as in names of joined words. A key of letters in one case alone can't be told from words; one of mixed
letters can. Base spans are never suppressed.

All column expressions: a row is scanned where it lies, without any shuffle.

* Null text counts as empty: no spans, and the hash of an empty list. Null ids stay null. No rows give no rows.
* A very long text is scanned whole. Repeated rows each give their row. Further columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveknn.llm.common import whole_text

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

# Strings that look random but are not secret.
ALLOW_LIST = (
    r"(.)\1{7}",  # runs of one character
    r"(?i)example|placeholder|changeme|dummy",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
)
NUMBERS = r"^[0-9._=+/-]*$"
PLAIN_WORD = r"(?<![A-Za-z])([a-z]+|[A-Z][a-z]*|[A-Z]+)(?![A-Za-z])"
LETTERS_OF_A_WORD = 5  # letters for each change of case in a name of joined words
WINDOW, SHORT = 24, 16
_SCALE = 1_000_000_000  # entropies are sums of integers, so they do not depend on the order of updates
_BLOCK = 256


@dataclass(frozen=True)
class CharacterClass:
    """Characters of a class and the entropy (bits a character) from which a window counts."""

    alphabet: str
    threshold: float


CLASSES = (
    CharacterClass("0123456789abcdef", 3.05),
    CharacterClass("0123456789ABCDEF", 3.05),
    CharacterClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
)


def _located(pattern: str) -> str:
    """SQL of ``array<struct<s, m>>``: start and text of each match of ``pattern`` in ``t``.

    The matches and what lies between them alternate, so starts are running sums of lengths; they are
    built block by block, so that texts of a million matches do not copy a growing array each time.
    """
    quoted = "r'" + pattern.replace("'", r"\x27") + "'"
    found = "array<struct<s:int,m:string>>"
    one_block = f"""aggregate(block, named_struct('t', acc.t, 'out', cast(array() as {found})),
        (a, x) -> named_struct('t', a.t + x.g + length(x.m), 'out', array_append(a.out, named_struct('s', a.t + x.g, 'm', x.m))))"""
    return f"""case when rlike(t, {quoted}) then transform(array(filter(zip_with(split(t, {quoted}, -1), regexp_extract_all(t, {quoted}, 0),
        (p, m) -> named_struct('g', length(p), 'm', m)), x -> x.m is not null)), z ->
      flatten(aggregate(transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> slice(z, cast(b * {_BLOCK} + 1 as int), {_BLOCK})),
        named_struct('t', 0, 'out', cast(array() as array<{found}>)),
        (acc, block) -> transform(array({one_block}), v -> named_struct('t', v.t, 'out', array_append(acc.out, v.out)))[0]).out))[0]
      else cast(array() as {found}) end"""


def _hot(kind: CharacterClass, window: int) -> str:
    """SQL of the struct ``(from, upto)`` of the candidate ``c``'s hot windows, null without any."""
    table = ",".join(str(round(n * math.log2(n) * _SCALE) if n else 0) + "L" for n in range(window + 2))
    most = int((math.log2(window) - kind.threshold) * window * _SCALE)
    alphabet = kind.alphabet
    gain = f"array({table})"
    # e: code of the entering character, l: of the leaving one (-1: none); s: sum of n * log2(n) over the counts.
    step = f"""case when e = l then struct(acc.n as n, acc.s as s) else struct(
        transform(acc.n, (k, j) -> case when j = e then k + 1 when j = l then k - 1 else k end) as n,
        acc.s + {gain}[acc.n[e] + 1] - {gain}[acc.n[e]] + case when l < 0 then 0L else {gain}[acc.n[l] - 1] - {gain}[acc.n[l]] end as s) end"""
    return f"""transform(array(transform(split(c.m, ''), ch -> locate(ch, '{alphabet}') - 1)), codes ->
      aggregate(sequence(0, size(codes) - 1),
        named_struct('n', array_repeat(0, {len(alphabet)}), 's', 0L, 'from', cast(null as int), 'upto', cast(null as int)),
        (acc, i) -> transform(array(named_struct('e', codes[i], 'l', case when i >= {window} then codes[i - {window}] else -1 end)), q ->
          transform(array({step.replace(" e ", " q.e ").replace("[e]", "[q.e]").replace("= e", "= q.e").replace("[l]", "[q.l]").replace("= l", "= q.l").replace("when l <", "when q.l <").replace("[acc.n[e]", "[acc.n[q.e]")}), w ->
            named_struct('n', w.n, 's', w.s,
              'from', case when acc.from is null and i >= {window - 1} and w.s <= {most}L then i - {window - 1} else acc.from end,
              'upto', case when i >= {window - 1} and w.s <= {most}L then i + 1 else acc.upto end))[0])[0],
        acc -> named_struct('from', acc.from, 'upto', acc.upto)))[0]"""


def _even(kind: CharacterClass, window: int) -> str:
    """SQL: does the candidate ``c``, shorter than ``window``, reach the threshold of its own length?"""
    gain = ",".join(str(round(n * math.log2(n) * _SCALE) if n else 0) + "L" for n in range(window))
    # The threshold keeps its proportion to log2 of the length, the most that so many characters can have.
    most = ",".join(str(int(n * math.log2(max(n, 1)) * (1 - kind.threshold / math.log2(window)) * _SCALE)) + "L" for n in range(window))
    return f"""aggregate(array_distinct(split(c.m, '')), 0L,
      (acc, ch) -> acc + array({gain})[length(c.m) - length(replace(c.m, ch, ''))]) <= array({most})[length(c.m)]"""


def _matches(text: str, patterns) -> str:
    return " or ".join(f"rlike({text}, r'{pattern}')" for pattern in patterns) or "false"


def _plain(text: str) -> str:
    """SQL: does the string look like words or plain numbers?"""
    count = lambda letters: f"length(regexp_replace(r, '[^{letters}]', ''))"
    joined = f"{LETTERS_OF_A_WORD} * least({count('A-Z')}, {count('a-z')}) <= {count('A-Za-z')}"
    words = f"transform(array(regexp_replace({text}, r'{PLAIN_WORD}', '')), r -> {joined})[0]"
    return f"rlike({text}, r'{NUMBERS}') or not rlike({text}, '[0-9]') and {words}"


def _letters(kind: CharacterClass) -> str:
    return kind.alphabet.replace("-", r"\-")


def entropy_spans(classes=CLASSES, window: int = WINDOW, allow_list=ALLOW_LIST) -> Column:
    """``array<struct<s, e, k>>`` of the entropy spans of column ``t``, of candidates as long as the window."""
    whole = [p for p in allow_list if p.removeprefix("(?i)").startswith("^")]
    inside = [p for p in allow_list if p not in whole]
    hot = "substring(c.m, c.h.from + 1, c.h.upto - c.h.from)"
    found = []
    for kind in classes:
        letters = _letters(kind)
        run = rf"(?<![{letters}])[{letters}]{{{window},}}"
        found.append(
            f"""transform(filter(transform(filter({_located(run)}, c -> not ({_matches("c.m", whole)})),
              c -> named_struct('s', c.s, 'm', c.m, 'h', {_hot(kind, window)})),
              c -> c.h.from is not null and not ({_matches(hot, inside)} or {_plain(hot)})),
              c -> named_struct('s', c.s + c.h.from, 'e', c.s + c.h.upto, 'k', 3))"""
        )
    return F.expr(f"array_distinct(concat({', '.join(found)}))")


def short_spans(classes=CLASSES, window: int = WINDOW, allow_list=ALLOW_LIST, least: int = SHORT) -> Column:
    """The same of candidates of ``least`` or more characters that are shorter than the window."""
    found = ["cast(array() as array<struct<s:int,e:int,k:int>>)"]
    for kind in classes if least < window else ():
        letters = _letters(kind)
        run = rf"(?<![{letters}])[{letters}]{{{least},{window - 1}}}(?![{letters}])"
        found.append(
            f"""transform(filter({_located(run)}, c -> not ({_matches("c.m", allow_list)} or {_plain("c.m")}) and {_even(kind, window)}),
              c -> named_struct('s', c.s, 'e', c.s + length(c.m), 'k', 3))"""
        )
    return F.expr(f"array_distinct(concat({', '.join(found)}))")


def base_spans() -> list[Column]:
    """The spans of ``assign``, ``access`` and ``hex`` of column ``t``."""
    value = "r'" + ASSIGN.replace("'", r"\x27") + "'"
    whole_run = rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}"  # the same as filtering all runs by length
    access = f"{ACCESS[:-1]}{{{ACCESS_LENGTH - 4},}}"
    keep = (
        (ASSIGN, f"length(regexp_extract(x.m, {value}, 2)) >= {ASSIGN_VALUE}"),
        (access, "true"),
        (whole_run, "true"),
    )
    return [
        F.expr(
            f"transform(filter({_located(pattern)}, x -> {condition}), x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'k', {kind}))"
        )
        for kind, (pattern, condition) in enumerate(keep)
    ]


def _listed(spans: str) -> str:
    names = "array('assign', 'access', 'hex', 'entropy')"
    ordered = f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    return f"array_join(transform({ordered}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def scan_secrets(docs: DataFrame, classes=CLASSES, window: int = WINDOW, allow_list=ALLOW_LIST) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy``."""
    assign, access, hexes = base_spans()
    found = docs.select("doc_id", whole_text().alias("t")).select(
        "doc_id",
        assign.alias("assign"),
        access.alias("access"),
        hexes.alias("hexes"),
        entropy_spans(classes, window, allow_list).alias("added"),
        short_spans(classes, window, allow_list).alias("short"),
    )
    found = found.withColumn(
        "added", F.expr("array_union(added, filter(short, x -> not exists(concat(assign, access, hexes), b -> b.s <= x.s and b.e >= x.e)))")
    )
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hexes").cast("long").alias("n_hex"),
        F.sha2(F.expr(_listed("concat(assign, access, hexes)")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_listed("concat(assign, access, hexes, added)")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
