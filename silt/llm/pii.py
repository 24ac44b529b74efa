"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base patterns (see ``BASE``) give spans that always stay.  High-recall generators (``WIDE``) then propose more: written-out or bracketed
e-mail addresses, IPv6 addresses, card numbers with unusual separators, telephone numbers without a plus sign or beside other digits.  Boosted
trees judge each proposal by its format and by the words around it.  Thresholds select what is added: for each kind the least margin at which, by isotonic regression on examples kept
apart from the fit, proposals of just that margin are right with ``PRECISION``.  The trees are fitted on the driver from ``EXAMPLES`` examples (no corpus row is needed), right ones
written out, wrong ones written out or proposed by the generators in written text (``TEXT``), and are
evaluated as CASE expressions.  Everything happens inside a row: there is no shuffle, and no state that could be lost.

A span's place comes from the text's pieces: ``split`` and ``regexp_extract_all`` by one pattern give gaps and matches in turn,
and running sums of their lengths, in blocks, give code-point offsets.  Patterns are possessive and anchored, so time is linear in the text.

Defined cases: null and empty texts have no spans, and redaction leaves them as they are; equal rows get equal results; null keys
stay; an empty table gives an empty result; other columns, whatever their names, stay through ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.boost import Boosted, Node, boosted, isotonic
from silt.llm.common import unused

KINDS = ["email", "ip", "card", "phone"]
# The contract's patterns, written so that no start inside a run is tried again and nothing is given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
_SEP = r"[\x20._/-]"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9A-Za-z])(?:(?:[0-9]{{4}}{_SEP}{{1,2}}+){{3}}[0-9]{{4}}(?!{_SEP}{{1,2}}[0-9]{{4}}(?![0-9]))|[0-9](?:{_SEP}{{0,2}}+[0-9]){{11,18}}+(?!{_SEP}{{1,2}}[0-9]))(?![0-9A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}+{_SEP}?+)?+(?:\(?[0-9]{{3}}\)?{_SEP}{{1,2}}+[0-9]{{3}}{_SEP}[0-9]{{4}}|\(?[0-9]{{2,5}}+\)?(?:{_SEP}{{1,2}}+\(?[0-9]{{2,5}}+\)?){{1,5}}+(?!{_SEP}{{1,2}}\(?[0-9]{{2}}))(?![0-9A-Za-z])",
}
# A document is searched by a wide pattern only if it holds this, which is a part of every match of the pattern.
GATE = {"email": rf"{_AT}[A-Za-z0-9-]{{1,63}}+{_DOT}[A-Za-z0-9-]", "ip": r":[0-9A-Fa-f]{0,4}+:", "card": r"[0-9]", "phone": r"[0-9]"}
OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0++)"
# Words near a span, by what they speak for.
WORDS = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip|host|server|address|login",
    "card": r"(?i)card|visa|master|credit|debit|pay",
    "phone": r"(?i)phone|tel|call|mobile|cell|fax|dial|contact",
    "other": r"(?i)order|invoice|version|page|isbn|date|ref|item|serial|year|score|ratio|build|total|no\.",
}
FEATURES = ["kind", "n_chars", "n_digits", "n_marks", "n_groups", "longest", "n_kinds", "luhn", "year", "bracket", "words_for", "words_against", "joined", "colons", "plus"]
EXAMPLES, SEED, PRECISION = 8000, 42, 0.7
CONTEXT = 24
BLOCK, CUT = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Inclusive running sums (or what ``join`` gives, from 0 on) of an array of longs, by blocks of BLOCK."""

    def whole(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(s) / BLOCK).cast("int") - 1)
        add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), join)
        sums = F.transform(blocks, lambda b: add(F.slice(s, b * BLOCK + 1, BLOCK)))
        return let(
            sums,
            lambda t: F.flatten(
                F.transform(
                    blocks,
                    lambda b: let(
                        F.struct(add(F.slice(t, F.lit(1), b)).alias("o"), F.slice(s, b * BLOCK + 1, BLOCK).alias("p")),
                        lambda v: F.transform(F.sequence(F.lit(1), F.size(v["p"])), lambda i: join(v["o"], add(F.slice(v["p"], F.lit(1), i)))),
                    ),
                )
            ),
        )

    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(steps, whole))


def pieces(text: Column, pattern: str) -> Column:
    """struct(g: the gaps, m: the matches): g[0] m[0] g[1] m[1] ... is the text."""
    return F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def one(a: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return a + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), one) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a base match stands."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(12, 19) & luhn(d))
    return F.length(digits(m)).between(9, 15)


def placed(v: Column, keep: Callable[[Column], Column], kind: str) -> Column:
    """Spans (start, kind number, end) of the matches among pieces ``v`` that ``keep`` (index) holds."""
    n = F.size(v["m"])
    steps = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.length(F.get(v["g"], i)) + F.when(i > 0, F.length(F.get(v["m"], i - 1))).otherwise(0)).cast("long"))
    )
    return let(
        running(steps),
        lambda s: F.filter(
            F.transform(
                s, lambda at, i: F.when(keep(i), F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(F.get(v["m"], i))).alias("end")))
            ),
            lambda x: x.isNotNull(),
        ),
    )


NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: Column, kind: str) -> Column:
    gate = text.contains({"email": "@", "phone": "+"}[kind]) if kind in ("email", "phone") else text.rlike("[0-9]")
    found = let(pieces(text, BASE[kind]), lambda v: placed(v, lambda i: valid(kind, F.get(v["m"], i)), kind))
    return F.when(gate, found).otherwise(F.array().cast(NO_SPANS))


def rebuilt(v: Column, keep: Callable[[Column], Column], put: Callable[[Column], Column]) -> Column:
    """The text of pieces ``v`` with ``put`` in place of the matches that ``keep`` (index) holds."""
    return F.array_join(
        F.transform(v["g"], lambda g, i: F.concat(F.when(i == 0, "").otherwise(let(F.get(v["m"], i - 1), lambda m: F.when(keep(i - 1), put(m)).otherwise(m))), g)), ""
    )


def _features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    d = digits(m)
    count = lambda pattern, c=m: F.size(F.split(c, pattern, -1)) - 1
    number = lambda c: c.cast("int")
    longest = F.array_max(F.transform(F.split(m, "[^0-9A-Za-z]+", -1), F.length))
    others = F.lit(False)
    for name in WORDS:
        if name not in (kind, "other"):
            others = others | before.rlike(WORDS[name])
    return [
        F.lit(KINDS.index(kind)), F.length(m), F.length(d), count("[^0-9A-Za-z]"), F.size(F.split(m, "[^0-9A-Za-z]+", -1)), longest,
        F.size(F.array_distinct(F.split(d, ""))), number(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)), number(m.rlike("^(?:19|20)[0-9]{2}\\b")),
        number(m.rlike("[()\\[\\]{}]")), number(before.rlike(WORDS[kind])), number(before.rlike(WORDS["other"]) | others),
        number(before.rlike("[0-9A-Za-z#$%=/]$")) + number(after.rlike("^[%$=/#:]")), count(":"), number(m.startswith("+")),
    ]


def _python_features(kind: str, m: str, before: str, after: str) -> list[float]:
    """The same numbers for one example."""
    import re

    d = re.sub("[^0-9]", "", m)
    parts = re.split("[^0-9A-Za-z]+", m)
    total = sum((2 * int(x) - 9 * (int(x) > 4)) if (len(d) - i) % 2 else int(x) for i, x in enumerate(d, 1))
    hit = lambda p, s: bool(re.search(p, s))
    return [
        KINDS.index(kind), len(m), len(d), len(re.findall("[^0-9A-Za-z]", m)), len(parts), max(map(len, parts)), len(set(d)) or 1, 12 <= len(d) <= 19 and total % 10 == 0,
        hit(r"^(?:19|20)[0-9]{2}\b", m), hit(r"[()\[\]{}]", m), hit(WORDS[kind], before), hit(WORDS["other"], before) or any(hit(p, before) for k, p in WORDS.items() if k not in (kind, "other")),
        hit("[0-9A-Za-z#$%=/]$", before) + hit("^[%$=/#:]", after), m.count(":"), m.startswith("+"),
    ]


def examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of written-out proposals, right and wrong ones, in contexts of both sorts."""
    import random

    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda k: "".join(r.choices("abcdefghijklmnoprstuvw", k=k))
    hexa = lambda: "".join(r.choices("0123456789abcdef", k=r.randint(1, 4)))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if sum((2 * int(x) - 9 * (int(x) > 4)) if (16 - i) % 2 else int(x) for i, x in enumerate(d + c, 1)) % 10 == 0)

    def case(kind: str, right: bool) -> str:
        sep = r.choice([" ", "-", ".", "/"])
        if kind == "email":
            at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", ".")])
            return f"{word(6)}{at}{word(7)}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if right else r.choice([f"{word(4)} at {word(3)}.{word(6)}", f"{word(5)} at {word(4)}.{word(2)}.{word(3)}"])
        if kind == "ip":
            return ":".join(hexa() for _ in range(8)) if right and r.random() < 0.7 else f"{hexa()}:{hexa()}::{hexa()}" if right else r.choice([f"{num(2)}:{num(2)}:{num(2)}", "::", f"{num(1)}:{num(2)}:{num(2)}", f"{word(1)}::"])
        if kind == "card":
            sep = r.choice([".", "/", "_", "  ", " ", "-"])
            d = card() if right else num(16)
            return sep.join(d[i : i + 4] for i in range(0, 16, 4)) if right or r.random() < 0.5 else r.choice([num(8) + "_" + num(6), num(14)])
        if right:
            return r.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(4)} {num(3)}"])
        return r.choice([f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(2)} {num(2)}", f"{num(3)}.{num(3)}", f"{num(2)}/{num(2)}", f"{num(4)} {num(2)} {num(3)}", f"{num(3)} {num(3)} {num(3)}"])

    near = {"email": ["mail me: ", "contact ", "write to "], "ip": ["from IP ", "server ", "host address "], "card": ["card ", "visa number ", "pay with credit "], "phone": ["phone: ", "call ", "tel. ", "mobile "]}
    far = ["order ", "invoice no. ", "version ", "isbn ", "date: ", "serial "]
    x, y, kinds = [], [], []
    wrong = {k: _in_text(k, r, num, word, hexa) for k in KINDS}
    for i in range(n):
        kind, right = KINDS[i % 4], r.random() < 0.5
        if not right and r.random() < 0.5:
            m, before, after = next(wrong[kind])
            x.append(_python_features(kind, m, before[-CONTEXT:], after[:8]))
            y.append(False)
            kinds.append(i % 4)
            continue
        m = case(kind, right)
        roll = r.random()
        before = r.choice(near[kind]) if roll < (0.45 if right else 0.08) else r.choice(far) if roll > (0.97 if right else 0.6) else f"{word(5)} {word(3)} "
        if kind == "card" and right and r.random() < 0.2:
            before = f"{word(3)} +1 ({num(3)}) {num(3)}-{num(4)} "  # digits before it, with which the base pattern took it together
        after = r.choice([" ", ".", ", ", " " + word(4)]) if right or r.random() < 0.8 else r.choice("%$=/")
        x.append(_python_features(kind, m, before, after))
        y.append(right)
        kinds.append(i % 4)
    return np.array(x, float), np.array(y, float), np.array(kinds)


# Sentences with numbers and words that the generators propose and that are nobody's data: # stands for a digit, w for a word, h for up to four hexadecimal digits.
TEXT = [
    "We met at w.w said so.", "Look at w.w.", "They arrived at w . w followed.", "Sold at w.w, bought at w.w.w.", "Open at w dot w.", "It starts at ww.w and ends at w.ww.",
    "It took ##:##:##.", "From ##:##:## to ##:##:##.", "Use w::w or ::w.", "The device h:h:h:h:h:h went off.", "A ratio of #:#:#.", "Keys ab:cd:ef:##:##:##:##:##:##:## differ.", "At ##:##:##:## it broke.", "see a::b",
    "Id ################ is free.", "Ticket ########_######.", "Serial ####-####-####.", "isbn ###-#-##-######-#", "isbn ###-##########", "Batch ##############.", "Code ####.####.####.####", "Sum ### ### ### ###.", "Run ####/####/####/####.", "No. ############", "Timestamps #############, ################.",
    "On ####-##-## we left.", "The ##.##.#### was a Monday.", "Pages ###-###.", "About ## ### people.", "## ### ### units.", "Version ##.##.##.", "Scores ##-## ##-##.", "At ##.#### ##.####.", "Line ###/###.", "Years ####-####.", "order #### ## ###", "Lot ### ### ###.", "It is ## 000 000.",
    "Room ##-###, floor ##.", "Table ## ## ## ##.", "Invoice ####-###-###.", "A span of ###.## - ###.##.",
]


def _in_text(kind: str, r, num, word, hexa):
    """Proposals of a generator in such sentences, one after the other with what stands around them, without end."""
    import re

    fill = {"#": lambda: num(1), "w": lambda: word(r.randint(2, 7)), "h": hexa}
    pattern = re.compile(WIDE[kind].replace("(?i:at)", "(?:at|AT)").replace("(?i:dot)", "(?:dot|DOT)"))
    while True:
        t = " ".join(" ".join(re.sub("#|w|\\bh\\b", lambda m: fill[m[0]](), x) if "#" in x or "w" in x or "h:" in x else x for x in r.choice(TEXT).split(" ")) for _ in range(4))
        for m in pattern.finditer(t):
            yield m[0], t[: m.start()], t[m.end() :]


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, list[float]]:
    """The trees, and for each kind the least margin whose own proposals are right with PRECISION, by the examples kept apart."""
    x, y, kinds = examples()
    apart = np.arange(len(y)) % 3 == 2
    trees = boosted(x[~apart], y[~apart])
    margins, cuts = trees.margin(x[apart]), []
    for k in range(len(KINDS)):
        own = kinds[apart] == k
        at, share = isotonic(margins[own], y[apart][own])
        i = int(np.searchsorted(share, PRECISION))
        cuts.append(float("inf") if i == len(at) else float(at[0]) if not i else float(np.interp(PRECISION, share[i - 1 : i + 1], at[i - 1 : i + 1])))
    return trees, cuts


def _tree(t: Node, v: Column) -> Column:
    if t.feature < 0:
        return F.lit(t.value)
    return F.when(v[FEATURES[t.feature]] <= t.cut, _tree(t.low, v)).otherwise(_tree(t.high, v))


def chosen(kind: str, v: Column, i: Column) -> Column:
    """Whether the trees select proposal ``i`` among pieces ``v``."""
    trees, cuts = model()
    before = F.substring(F.get(v["g"], i), -CONTEXT, CONTEXT)
    after = F.substring(F.get(v["g"], i + 1), 1, 8)
    held = let(
        F.struct(F.get(v["m"], i).alias("m"), before.alias("b"), after.alias("a")),
        lambda c: let(F.struct(*[x.cast("double").alias(n) for x, n in zip(_features(kind, c["m"], c["b"], c["a"]), FEATURES)]), lambda f: sum((_tree(t, f) for t in trees.trees), F.lit(trees.start))),
    )
    return held >= F.lit(cuts[KINDS.index(kind)])


def wide_step(text: Column, kind: str) -> Column:
    """struct(t: the text with what is added blanked out, s: the spans added); offsets don't move."""
    blank = lambda m: F.repeat(F.lit("█"), F.length(m))
    step = let(
        pieces(text, WIDE[kind]),
        lambda v: let(
            F.struct(v["g"].alias("g"), v["m"].alias("m"), F.transform(v["m"], lambda _, i: chosen(kind, v, i)).alias("k")),
            lambda u: F.struct(rebuilt(u, lambda i: F.get(u["k"], i), blank).alias("t"), placed(u, lambda i: F.get(u["k"], i), kind).alias("s")),
        ),
    )
    return F.when(text.rlike(GATE[kind]), step).otherwise(F.struct(text.alias("t"), F.array().cast(NO_SPANS).alias("s")))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given as blocks of CUT code points: no long text is walked from its beginning for each piece."""
    first, last = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
    head = lambda k: F.substring(F.coalesce(F.get(blocks, first), F.lit("")), (start % CUT + 1).cast("int"), k)
    across = F.concat(head(F.lit(CUT)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), (end % CUT).cast("int")))
    return F.when(first == last, head((end - start).cast("int"))).otherwise(across)


def covered(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with ``put`` (kind, length) in place of its spans; spans that overlap are one, of the first one's kind."""

    def opened(v: Column) -> Column:
        """struct(start, kind, i: its index) of each span that doesn't overlap one before, given struct(s: sorted spans, e: largest ends so far)."""
        free = lambda s, i: F.when((i == 0) | (s["start"] >= F.get(v["e"], i - 1)), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i")))
        return F.filter(F.transform(v["s"], free), lambda x: x.isNotNull())

    def built(v: Column, o: Column) -> Column:
        ends = F.transform(o, lambda x, j: F.get(v["e"], F.coalesce(F.get(o, j + 1)["i"], F.size(v["s"])) - 1))
        part = lambda w, x, j: F.concat(cut(w["b"], F.coalesce(F.get(w["e"], j - 1), F.lit(0).cast("long")), x["start"]), put(x["kind"], (F.get(w["e"], j) - x["start"]).cast("int")))
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
        rest = lambda w: cut(w["b"], F.element_at(w["e"], -1), F.length(text).cast("long"))
        return let(F.struct(ends.alias("e"), blocks.alias("b")), lambda w: F.concat(F.array_join(F.transform(o, lambda x, j: part(w, x, j)), ""), rest(w)))

    whole = lambda s: let(F.struct(s.alias("s"), running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("e")), lambda v: let(opened(v), lambda o: built(v, o)))
    return F.when(F.size(spans) > 0, let(F.array_sort(spans), whole)).otherwise(text)


def with_spans(docs: DataFrame, text: str = "text", base: str = "base", added: str = "added") -> DataFrame:
    """``docs`` and two arrays of spans (start, kind number, end), under names that ``docs`` doesn't have: the base ones and those that the trees add."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(base, F.concat(*[base_spans(whole, k) for k in KINDS]))
    some = F.exists(F.array(*[whole.rlike(g) for g in GATE.values()]), lambda x: x)
    left, *steps = unused(out, "left", *KINDS)
    out = out.withColumn(left, F.when(some, covered(whole, F.col(base), lambda _, n: F.repeat(F.lit("█"), n))).otherwise(""))
    for k, step in zip(KINDS, steps):
        out = out.withColumn(step, wide_step(F.col(left), k)).withColumn(left, F.col(f"{step}.t"))
    return out.withColumn(added, F.concat(*[F.col(f"{step}.s") for step in steps])).drop(left, *steps)


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = with_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    of = lambda j: F.filter("base", lambda s: s["kind"] == j)
    counts = [F.size(of(j)).cast("long").alias(f"n_{k}") for j, k in enumerate(KINDS)]
    return found.select(F.col("key").alias(key), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with [EMAIL], [IP], [CARD] or [PHONE] in place of each span that ``report`` finds; spans that overlap share the first one's."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base, added = unused(docs, "base", "added")
    found = with_spans(docs, text, base, added)
    return found.withColumn(text, covered(F.col(text), F.concat(base, added), lambda k, _: F.get(names, k))).select(*docs.columns)
