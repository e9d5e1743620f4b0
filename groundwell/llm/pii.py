"""Personal data by candidate spans and gradient boosting, with DataFrame functions only.

Base kinds are regular expressions with a check of each match (``email``, ``ip``, ``card``, ``phone``); their spans always stay.
The method adds ``secret``, ``id_number``, ``local_phone`` and ``masked_email``: generators of high recall propose spans, which may overlap each
other and the base ones, with the characters before and after them; boosted trees score each by features of its format and
context; a threshold for each kind, calibrated on examples held out from the trees, selects the redactions. There are no labelled spans:
the trees are trained here on generated examples and, as weak negatives, on a bounded number of candidates of the texts
themselves (see :func:`harvest`), and become one expression of nested conditions, so whole texts stay in the JVM. A span that lies wholly inside a base span is dropped, as that is redacted anyhow; one that only overlaps it
stays, and the union of overlapping spans is redacted.

Spans have code-point offsets, end exclusive. A regular expression runs over a text for the matches and, where there are any, once
more for what lies between. Patterns are possessive and anchored to the starts of runs, so time stays linear in runs of any length;
offsets are summed and texts put together in blocks, so it grows with the number of spans to the power of 1.5 at most.

Defined results: null or empty text has no spans; null and repeated ids are rows like any other; an empty table gives an empty
result; other columns pass through :func:`redact` unchanged and are ignored by :func:`find`.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.vectors import _let
from groundwell.llm.shared import id_and_text, stored, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
_SPAN = "array<struct<start: bigint, end: bigint, value: string, before: string, after: string>>"

# A match begins at the start of a run or right after the last match: elsewhere in a run it would have begun earlier.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _running(values: Column, start: Column, step) -> Column:
    """For each value what ``step`` makes of ``start`` and all values before it, in order; and at last what it makes of all.

    An array that grows by one in a fold is copied each time, so values are folded in blocks of about the root of their number.
    """
    blocks = lambda v, b: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), b), lambda i: F.slice(v, i + 1, b))
    fold = lambda v, first: F.aggregate(v, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    width = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")

    def over(v: Column) -> Column:
        return _let(F.transform(blocks(v, width(v)), lambda block: fold(block, start)), joined)

    def joined(inner: Column) -> Column:
        before = fold(F.transform(inner, lambda p: F.element_at(p, -1)), start)
        shifted = F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: step(o, v)))
        return F.concat(F.flatten(shifted), F.array(F.element_at(before, -1)))

    return _let(values, over)


def spans(text: Column, pattern: str, worth: Column | None = None) -> Column:
    """Leftmost matches that do not overlap, with up to 32 characters before and 8 after each."""
    none = F.array().cast(_SPAN)

    def cut(found: Column) -> Column:
        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), lambda between: placed(found, between))).otherwise(none)

    def placed(found: Column, between: Column) -> Column:
        sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, v: (F.length(g) + F.length(v)).cast("bigint"))
        rows = F.arrays_zip(found.alias("value"), F.slice(between, 1, F.size(found)).alias("gap"), F.slice(between, 2, F.size(found)).alias("next"), F.slice(_running(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x), 1, F.size(found)).alias("at"))
        return F.transform(rows, span)

    def span(x: Column) -> Column:
        begin = x["at"] + F.length(x["gap"])
        return F.struct(begin.alias("start"), (begin + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(32)).alias("before"), F.left(x["next"], F.lit(8)).alias("after"))

    out = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)
    return out if worth is None else F.when(worth, out).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int") * (F.lit(2) - k % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(F.length(digits).between(13, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """The checked spans of each base kind."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    return {
        "email": spans(text, _EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, _IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["value"].rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")),
        "card": F.filter(spans(text, _CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){12}")), lambda x: _luhn(digits(x))),
        "phone": F.filter(spans(text, _PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(digits(x)).between(9, 15)),
    }


# Generators: what they propose. Only the format counts here; context is for the trees.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
    "id_number": r"(?<![0-9])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9])",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{2,4}\) ?)?[0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?+(?![0-9])",
    "masked_email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Z0-9-]++)++",
}
# Words that tell what follows, in the languages of the texts and their neighbours.
_SECRET_WORDS = ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential", "kennwort", "schlüssel", "geheim", "mot de passe", "clé", "jeton", "contraseña", "clave", "secreto")
_NUMBER_WORDS = ("ssn", "social", "tax", "passport", "id no", "id number", "identity", "sozialversicherung", "steuer", "reisepass", "ausweis", "sécurité sociale", "passeport", "identité", "seguridad social", "pasaporte", "dni", "nif")
_PHONE_WORDS = ("phone", "tel", "call", "fax", "mobile", "telefon", "anruf", "handy", "rufnummer", "téléphone", "tél", "appel", "portable", "teléfono", "llam", "móvil")
_MAIL_WORDS = ("mail", "contact", "write", "reach", "kontakt", "schreib", "erreich", "écri", "joindre", "contacte", "escrib", "correo")
# Endings of domains that addresses in these languages have most.
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "dev", "eu", "de", "at", "ch", "fr", "be", "es", "mx", "ar", "uk", "us", "ca", "au")
# A secret's name may end in such a word ("apikey"); the others begin with theirs.
_CONTEXT = {"secret": f"(?iu)(?:{'|'.join(_SECRET_WORDS)})", "number": rf"(?iu)(?<!\p{{L}})(?:{'|'.join(_NUMBER_WORDS)})", "phone": rf"(?iu)(?<!\p{{L}})(?:{'|'.join(_PHONE_WORDS)})", "mail": rf"(?iu)(?:{'|'.join(_MAIL_WORDS)})"}


def features(x: Column, kind: str) -> list[Column]:
    """Numbers on a candidate's format and context; the order is that of the trees."""
    value, before = x["value"], x["before"]
    size = F.length(value)
    count = lambda pattern: size - F.length(F.regexp_replace(value, pattern, ""))
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    return [
        size,
        count("[0-9]"),
        (100 * count("[0-9]") / size).cast("int"),
        (100 * count("[0-9A-Fa-f]") / size).cast("int"),
        (100 * count("[A-Z]") / size).cast("int"),
        count("[ ().-]"),
        flag(before.rlike(_CONTEXT["secret"])),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(before.rlike(_CONTEXT["number"])),
        flag(before.rlike(_CONTEXT["phone"])),
        flag(x["after"].rlike(r"^[\"']")),
        count("-"),
        *((F.length(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)), flag(value.rlike(rf"(?i)(?<![A-Z0-9-])(?:{'|'.join(_ENDINGS)})$")), flag(before.rlike(_CONTEXT["mail"]))) if kind == "masked_email" else (F.lit(0), F.lit(0), F.lit(0))),
        *(flag(F.lit(kind == k)) for k in list(GENERATORS)[1:]),
    ]


def examples(seed: int = 5, n: int = 150) -> list[tuple[str, int, str, str, str]]:
    """Generated candidates (kind, label, value, before, after): personal data, and what looks like it."""
    r = random.Random(seed)
    text = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    low, hexa, full = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    prose = lambda: " ".join(text(low, 2, 8) for _ in range(6))[-r.randint(8, 32) :]
    out = []
    label = lambda: r.choice((text(low, 3, 10), f"{text(low, 2, 7)} {text(low, 3, 8)}", f"{text(low, 3, 8)}_{text(low, 3, 6)}"))  # noqa: E731  a name that no list knows
    for _ in range(n):
        name = r.choice(("token", "api_key", "secret", "password", "Authorization", "auth_token", "client_secret"))
        set_to = r.choice((" = ", "=", ": ", ":"))
        quote = r.choice(('"', "'", ""))
        mixed = lambda: r.choice((text(hexa, 24, 64), text(full, 20, 64)))
        out.append(("secret", 1, mixed(), f"{prose()[-12:]} {r.choice((name, name, label()))}{set_to}{quote}"[-32:], quote))
        out.append(("secret", 0, text(low, 16, 30), f"{prose()} ", " "))  # a long word
        out.append(("secret", 0, text(low, 16, 30), f"{prose()[-12:]} {name} of the "[-32:], " "))
        out.append(("secret", 0, text(low, 16, 30), f"{prose()[-12:]} {label()}: "[-32:], " "))
        out.append(("secret", 0, text(hexa, 24, 64), f"{prose()} ", " "))  # a digest in prose
        out.append(("secret", 0, text("0123456789", 16, 20), f"{prose()} ", " "))
        out.append(("secret", 0, "/".join(text(low, 3, 9) for _ in range(4)), f"{prose()[-9:]} {r.choice(('path', 'url', 'file', label()))}{set_to}{quote}"[-32:], quote))
        grouped = f"{text('0123456789', 3, 3)}-{text('0123456789', 2, 2)}-{text('0123456789', 4, 4)}"
        out.append(("id_number", 1, grouped, f"{prose()} {r.choice(('SSN', 'ssn', 'social security', 'tax id', 'passport'))}{r.choice((': ', ' ', ' no. '))}"[-32:], " "))
        out.append(("id_number", 1, grouped, f"{prose()} {label()}: "[-32:], " "))
        out.append(("id_number", 0, r.choice((grouped, grouped.replace("-", " "))), f"{prose()} ", " "))
        out.append(("id_number", 0, grouped.replace("-", " "), f"{prose()} {label()}: "[-32:], " "))
        digits = lambda k: text("0123456789", k, k)
        local = r.choice((f"({digits(3)}) ", "")) + f"{digits(3)}-{digits(4)}"
        out.append(("local_phone", 1, local, f"{prose()} {r.choice(('phone', 'tel.', 'call', 'fax', 'mobile'))}{r.choice((': ', ' '))}"[-32:], " "))
        out.append(("local_phone", 1, f"({digits(3)}) {digits(3)}-{digits(4)}", f"{prose()} {label()}: "[-32:], " "))
        years = f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}"
        out.append(("local_phone", 0, r.choice((years, f"{digits(2)}.{digits(3)}", f"{digits(3)} {digits(3)}", local)), f"{prose()} ", " "))
        out.append(("local_phone", 0, r.choice((years, f"{digits(3)}.{digits(3)}", f"{digits(3)} {digits(3)}")), f"{prose()} {label()}: "[-32:], " "))
        at, dot, gap = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("(AT)", "(DOT)"))) + (r.choice((" ", "")),)
        domain = f"{text(low, 3, 9)}{gap}{dot}{gap}{r.choice((text(low, 3, 8) + gap + dot + gap, ''))}"
        lead = f"{prose()[-18:]} {r.choice(('', 'mail: ', 'contact ', label() + ' '))}"[-32:]
        out.append(("masked_email", 1, f"{text(low, 3, 9)}{r.choice(('', '.' + text(low, 3, 8)))}{gap}{at}{gap}{domain}{r.choice(_ENDINGS)}", lead, " "))
        out.append(("masked_email", 0, f"{text(low, 2, 9)}{gap}{at}{gap}{domain}{text(low, 3, 9)}", f"{prose()[-18:]} ", " "))  # speech that spells signs out
        out.append(("masked_email", 0, f"{text(low, 2, 9)} {at} {digits(1)} {dot} {digits(2)}", f"{prose()[-18:]} {r.choice(('', label() + ': '))}"[-32:], " "))
    return out


class BoostedTrees:
    """Logistic gradient boosting of trees of fixed depth; a tree is (feature, bound, left, right) or a leaf."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.4):
        self.rounds, self.depth, self.rate, self.trees, self.start = rounds, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.width = x.shape[1]
        share = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            f += np.array([self._leaf(tree, row) for row in x])
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(self.rate * g.sum() / (h.sum() + 1))
        best, gain = None, 1e-6
        for feature in range(x.shape[1]) if depth else ():
            order = np.argsort(x[:, feature], kind="stable")
            v, cg, ch = x[order, feature], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                score = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                k = int(np.argmax(score))
                if score[k] > gain:
                    best, gain = (feature, float((v[at[k]] + v[at[k] + 1]) / 2)), score[k]
        if not best:
            return leaf
        left = x[:, best[0]] < best[1]
        return (*best, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _leaf(self, tree, row: np.ndarray) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.start + sum(self._leaf(t, row) for t in self.trees) for row in x])

    def column(self, values: list[Column]) -> Column:
        """The same sum as an expression."""

        def node(tree) -> Column:
            return F.when(values[tree[0]] < tree[1], node(tree[2])).otherwise(node(tree[3])) if isinstance(tree, tuple) else F.lit(tree)

        return reduce(lambda a, b: a + b, (node(t) for t in self.trees), F.lit(self.start))


_FIELDS = "kind string, label int, value string, before string, after string"


def harvest(texts: DataFrame, sample_rows: int = 2000, per_kind: int = 300) -> list[tuple[str, int, str, str, str]]:
    """Candidates of real texts as weak negatives: those that have no context word of their kind, nor stand behind an equals sign, a colon or the start of a telephone number.

    About ``sample_rows`` texts are looked at, by the hash of the text, and of each kind the ``per_kind`` candidates with the smallest hash are
    taken, so the same texts give the same examples, however they are stored.
    """
    every = max(1, -(-texts.count() // sample_rows))
    context = {"secret": "secret", "id_number": "number", "local_phone": "phone"}  # what looks like a masked address is one
    named = lambda kind: F.transform(spans(F.col("text"), GENERATORS[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))
    found = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.explode(F.concat(*map(named, context))).alias("x")).select("x.*").distinct()
    found = stored(found, "pii-candidates")  # one pass over the texts
    parts = []
    for kind, words in context.items():
        known = F.col("before").rlike(_CONTEXT[words]) | F.col("before").rlike(r"[=:]\s*[\"']?$") | F.col("before").rlike(r"\+[0-9][\x20().0-9-]*$")
        plain = found.where((F.col("kind") == kind) & ~known)
        parts.append(plain.orderBy(F.xxhash64("value", "before"), "value", "before", "after").limit(per_kind).select("kind", F.lit(0).alias("label"), "value", "before", "after"))
    return sorted(tuple(r) for r in reduce(DataFrame.unionAll, parts).collect())


def train(spark: SparkSession, precision: float = 0.99, texts: DataFrame | None = None) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees from half of the examples, generated ones and those that ``texts`` (``text``) give; of the others, the bound of each kind below which the precision would be less, half way to the next."""
    rows = examples() + (harvest(texts) if texts is not None else [])
    made = spark.createDataFrame(rows, _FIELDS)
    x = F.struct("value", "before", "after")
    by_kind = [made.where(F.col("kind") == kind).select("kind", "label", "value", F.array(*(c.cast("double") for c in features(x, kind))).alias("x")) for kind in GENERATORS]
    found = sorted((tuple(r) for r in reduce(DataFrame.unionAll, by_kind).collect()), key=lambda r: (r[:3], tuple(r[3])))  # as many as examples
    values, labels = np.array([r[3] for r in found]), np.array([r[1] for r in found])
    half = np.arange(len(found)) % 2 == 0
    trees = BoostedTrees().fit(values[half], labels[half])
    scores, bounds = trees.scores(values), {}
    for kind in GENERATORS:
        own = ~half & np.array([r[0] == kind for r in found])
        order = np.argsort(-scores[own], kind="stable")
        right = np.cumsum(labels[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        ranked = np.append(scores[own][order], 0.0)
        bounds[kind] = max(float(ranked[good[-1] : good[-1] + 2].mean()), 0.0) if len(good) else float("inf")
    return trees, bounds


def _selected(text: Column, kind: str, trees: BoostedTrees, bound: float) -> Column:
    # features are computed once for a candidate; in each node of the trees they would make an expression of thousands of parts
    score = lambda x: _let(F.array(*(c.cast("double") for c in features(x, kind))), lambda v: trees.column([v[k] for k in range(trees.width)]))
    return F.filter(spans(text, GENERATORS[kind]), lambda x: score(x) >= bound)


def _with_spans(df: DataFrame) -> DataFrame:
    """Adds a column of spans for each kind, named as the kind, to a table with ``text``."""
    trees, bounds = train(df.sparkSession, texts=df.select("text"))
    text = F.col("text")
    df = df.withColumns(base_spans(text))
    known = F.concat(*map(F.col, BASE_KINDS))
    added = {kind: _selected(text, kind, trees, bounds[kind]) for kind in GENERATORS}
    apart = lambda found: F.filter(found, lambda x: ~F.exists(known, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return df.withColumns({kind: _let(c, lambda found: F.when(F.size(found) > 0, apart(found)).otherwise(found)) for kind, c in added.items()})


def _listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, joined by commas."""
    return F.array_join(F.concat(*(F.transform(kind, _written(kind)) for kind in kinds)), ",")


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])


def _named(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: counts of base kinds, the digest of their spans, and all spans."""
    found = _with_spans(id_and_text(df, id_col, text_col))
    return found.select(F.col("id").alias(id_col), *(F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in BASE_KINDS), F.sha2(_listed(BASE_KINDS), 256).alias("base_sha256"), _listed((*BASE_KINDS, *GENERATORS)).alias("spans"))


_BLOCK = 4096


def _replaced(text: Column, every: Column) -> Column:
    """The text with each span of ``every``, which is not empty, replaced by its kind; overlapping spans become one.

    A substring counts characters from the start of its text, so the text is cut into blocks first and gaps are taken from those.
    """

    def of(blocks: Column) -> Column:
        ends = _running(F.transform(every, lambda x: x["end"]), F.lit(0).cast("bigint"), F.greatest)
        spaced = F.arrays_zip(every.alias("span"), F.slice(ends, 1, F.size(every)).alias("at"))
        fresh = F.filter(spaced, lambda x: x["span"]["start"] >= x["at"])
        pieces = F.transform(fresh, lambda x: F.concat(_between(blocks, x["at"], x["span"]["start"]), F.lit("<"), x["span"]["kind"], F.lit(">")))
        return F.concat(F.array_join(pieces, ""), _between(blocks, F.element_at(ends, -1), F.length(text).cast("bigint")))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), of)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` of the text that ``blocks`` make."""
    size = F.lit(_BLOCK)
    first, last = (F.floor(start / size).cast("int"), F.floor((end - 1) / size).cast("int"))
    at = (start % size).cast("int")
    head = F.substring(F.element_at(blocks, first + 1), at + 1, size)
    tail = F.substring(F.element_at(blocks, last + 1), F.lit(1), ((end - 1) % size + 1).cast("int"))
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    one = F.substring(F.element_at(blocks, first + 1), at + 1, (end - start).cast("int"))
    return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(F.concat(head, inner, tail))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    ``length_col`` names a column that holds the length of the text and follows where the text changed.
    """
    whole = df.select(F.struct("*").alias("row"), text_of(text_col).alias("text"))
    found = _with_spans(whole)
    every = F.array_sort(F.concat(*(F.transform(kind, _named(kind)) for kind in (*BASE_KINDS, *GENERATORS))))
    found = found.select("row", "text", every.alias("every"))
    found = found.select("row", F.when(F.size("every") > 0, _replaced(F.col("text"), F.col("every"))).alias("text"))
    fresh = {text_col: F.col("text")} | ({length_col: F.length("text").cast(df.schema[length_col].dataType)} if length_col else {})
    own = lambda name: F.col("row").getField(name)
    return found.select(*((F.when(F.col("text").isNotNull(), fresh[name]).otherwise(own(name)) if name in fresh else own(name)).alias(name) for name in df.columns))
