"""Personal data: pattern spans, and further candidates that boosted trees accept or reject.

Everything that touches the documents is a SQL function. Only fitting the trees, on a few thousand made-up lines, runs on the driver.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive loops and run starts where these match the same text without backtracking.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*[0-9]",  # over a text whose double separators are blotted out
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for any match: a cheap test before the patterns.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][0-9\x20-]{10,}[0-9]", "phone": r"\+[0-9]"}
#: High-recall generators of further spans; they overlap one another and much that is no personal data.
MORE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?(?:\(at\)|\[at\]|\{{at\}}|\x20at\x20|@)\x20?[A-Za-z0-9-]{{1,63}}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}}|\x20dot\x20)\x20?|\.)[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){2}[\x20./_-]{1,3}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{0,2}[0-9]{2,4}[\x20.-]?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4})?(?![0-9A-Za-z])",
}
MORE_HINT = {"email": r"[\(\[\{\x20](?:at|dot)[\)\]\}\x20]", "ip": r"[0-9A-Fa-f](?:\[|\(|:)", "card": r"[0-9]{4}[\x20./_-]{1,3}[0-9]{4}[\x20./_-]", "phone": r"[0-9][0-9)\x20./-]{5,}[0-9]"}
WORDS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)",
    "ip": r"(?i)\b(?:ip|host|address|server|from|login|adresse)\b",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(?:phone|tel\b|tel[.:]|call|fax|mobile|cell|handy|telefon|tel.fono|dial)",
    "other": r"(?i)(?:order|invoice|ticket|version|isbn|ref\b|serial|page|row|total|sum|year|date|item|batch|build|id\b|nr\b|no\.)",
}
FEATURES = ("sort", "length", "digits", "groups", "brackets", "dashes", "spaces", "dots", "slashes", "luhn", "prefix", "own_word", "other_word", "marked", "distinct", "tld", "year")
TREES, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.98


def _let(expr: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(expr), body), 0)


def _sums(steps: Column, block: int = 64) -> Column:
    """Running sums of an array of ints, in blocks: cost grows with the length times its blocks' number, not with its square."""

    def added(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / block).cast("int") - 1, F.lit(0))), lambda i: added(F.slice(v, i * block + 1, F.lit(block))))
        ends = lambda b: F.concat(F.array(F.lit(0)), added(F.transform(b, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, F.slice(ends(b), F.lit(1), F.size(b)), lambda x, base: F.transform(x, lambda y: y + base))))

    return _let(steps, of)


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap; positions in code points."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    sized = F.transform(F.filter(both, lambda x: x["hit"].isNotNull()), lambda x: F.struct((F.length(x["gap"]) + F.length(x["hit"])).alias("step"), F.length(x["hit"]).alias("size"), x["hit"].alias("value")))
    place = lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["value"].alias("value"))
    return _let(sized, lambda v: F.zip_with(v, _sums(F.transform(v, lambda x: x["step"])), place))


_NONE = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, d: F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.when(acc["i"] % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.coalesce((digits != "") & (total % 10 == 0), F.lit(False))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of the base spans, by start, then kind."""
    blotted = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "x")
    good = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= F.when(F.regexp_replace(p, "^0+", "") <= "255", 3).otherwise(2)),
        "card": lambda v: F.length(_digits(v)).between(12, 19) & _luhn(_digits(v)),
        "phone": lambda v: F.length(_digits(v)).between(9, 15),
    }

    def part(rank: int, kind: str) -> Column:
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINT[kind])
        found = F.when(hint, _found(blotted if kind == "card" else text, BASE[kind])).otherwise(F.array().cast(_NONE))
        kept = F.filter(found, lambda x: good[kind](x["value"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[part(rank, kind) for rank, kind in enumerate(KINDS)]))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, rank, end, kind, FEATURES>> of further spans that no base span touches."""

    def part(rank: int, kind: str) -> Column:
        found = F.when(text.rlike(MORE_HINT[kind]), _found(text, MORE[kind])).otherwise(F.array().cast(_NONE))
        free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return F.transform(free, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), *_features(text, x, rank, kind)))

    return F.concat(*[part(rank, kind) for rank, kind in enumerate(KINDS)])


def _features(text: Column, x: Column, rank: int, kind: str) -> list[Column]:
    v, digits = x["value"], _digits(x["value"])
    before = F.substring(text, F.greatest(x["start"] - 29, F.lit(1)), F.least(x["start"], F.lit(30)))
    count = lambda chars: F.length(v) - F.length(F.translate(v, chars, ""))
    got = {
        "sort": F.lit(rank), "length": F.length(v), "digits": F.length(digits), "groups": F.size(F.regexp_extract_all(v, F.lit("[0-9A-Za-z]+"), F.lit(0))),
        "brackets": count("()[]{}"), "dashes": count("-_"), "spaces": count(" "), "dots": count("."), "slashes": count("/"), "luhn": _luhn(digits).cast("int"),
        "prefix": v.rlike(r"^(?:\(|00)").cast("int"), "own_word": before.rlike(WORDS[kind]).cast("int"), "other_word": before.rlike(WORDS["other"]).cast("int"),
        "marked": v.rlike(r"(?:\(at\)|\[at\]|\{at\}|\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\))").cast("int"), "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "tld": v.rlike(r"(?i)[. \])}](?:com|org|net|edu|gov|io|de|fr|es|uk|info)$").cast("int"), "year": v.rlike(r"^(?:19|20)[0-9]{2}[ ./-]").cast("int"),
    }
    return [got[n].cast("int").alias(n) for n in FEATURES]


class Trees:
    """Gradient boosting with the logistic loss over small integer features; a calibrated threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        fit = np.arange(len(y)) % 3 != 0
        self.bias = float(np.log((y[fit].mean() + 1e-6) / (1 - y[fit].mean() + 1e-6)))
        score, self.trees = np.full(fit.sum(), self.bias), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x[fit], y[fit] - p, p * (1 - p), np.arange(fit.sum()), DEPTH)
            self.trees.append(tree)
            score = score + self._apply(tree, x[fit])
        # On the third of the lines that no tree has seen: a slope and a shift that calibrate, then the lowest threshold with the precision asked for.
        z, t = self.raw(x[~fit]), y[~fit]
        self.slope, self.shift = 1.0, 0.0
        for _ in range(25):  # Newton steps, slightly damped so that separable scores stay finite
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            g, h = np.array([((p - t) * z).sum() + 0.01 * (self.slope - 1), (p - t).sum()]), p * (1 - p)
            hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
            d = np.linalg.solve(hess, g)
            self.slope, self.shift = float(self.slope - d[0]), float(self.shift - d[1])
        prob, self.cut = 1 / (1 + np.exp(-(self.slope * z + self.shift))), []
        for k in range(len(KINDS)):
            own = x[~fit][:, 0] == k
            steps = [c for c in np.arange(0.9, 0.995, 0.01) if t[own & (prob >= c)].sum() >= PRECISION * max(1, (own & (prob >= c)).sum())]
            self.cut.append(float(min(steps, default=0.99)))

    def _grow(self, x, g, h, rows, depth):
        best, gs, hs = None, g[rows].sum(), h[rows].sum()
        if depth and len(rows) >= 20:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= cut
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, f, int(cut), left)
        if best is None or best[0] < 1e-3:
            return float(RATE * gs / (hs + 1))
        _, f, cut, left = best
        return (f, cut, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._apply(a, x), self._apply(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._apply(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        """The calibrated probability as an expression over a candidate."""

        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, a, b = tree
            return F.when(x[FEATURES[f]] <= cut, walk(a)).otherwise(walk(b))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + walk(tree)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))


def made_up(seed: int = 11, n: int = 2400) -> list[tuple[str, int]]:
    """Lines that hold one candidate each, and whether it is personal data: n of them, drawn from a seed.

    A line is put together from parts drawn independently: words in front, a format, separators, digits, words behind. So no line's form fixes its label
    alone: bare numbers count by what stands in front, spelled addresses by how they are spelled.
    """
    r, out = random.Random(seed), []
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    near = {
        "phone": "call phone tel: tel. fax mobile cell handy telefon dial whatsapp number: reach".split(), "email": "mail contact write e-mail: email kontakt correo send reach".split(),
        "ip": "host ip from server login address: node peer".split(), "card": "card visa credit-card mastercard debit karte pay".split(),
        "other": "order invoice ticket isbn ref serial page row total sum year date item batch build id no. version nr article lot".split(),
    }

    def words(lo: int, hi: int) -> str:
        return " ".join(w() for _ in range(r.randint(lo, hi)))

    def digits(groups: tuple[int, ...], seps: str) -> str:
        sep = r.choice(seps)
        return sep.join(d(k) for k in groups)

    def phone() -> str:
        form = r.choice(((3, 3, 4), (3, 4), (4, 6), (5, 5), (2, 2, 2, 2), (3, 2, 2), (2, 4, 4)))
        body = digits(form, " .-/")
        if r.random() < 0.35:
            body = f"({d(r.randint(2, 4))}){r.choice(['', ' ', '-'])}{digits(form[1:] or form, ' .-')}"
        return f"00{r.choice(['49', '33', '34', '44', '1', '39', '351'])}{r.choice(' .-')}{body}" if r.random() < 0.25 else body

    def email() -> tuple[str, int]:
        at = r.choice(["(at)", "[at]", "{at}", " at ", " (at) ", " [at] "])
        dot = r.choice([".", ".", "(dot)", "[dot]", " dot ", " (dot) "])
        local = r.choice([f"{w()}.{w()}", f"{w()}{d(2)}", w(), f"{w()}_{w()}"])
        tld = r.choice("com org net edu de fr es it io info eu uk ch".split())
        spelled = at.strip() != "at" or dot.strip() == "dot" or "." in local or local[-1].isdigit() or "_" in local
        return f"{local}{at}{w()}{r.choice(['', '-' + w()])}{dot}{tld}", int(spelled)

    for _ in range(n):
        kind, good = r.choice(("phone", "phone", "email", "ip", "card")), r.random() < 0.5
        front = r.choice(near[kind if good else "other"]) if r.random() < 0.85 else w()
        if kind == "email":
            text, y = email()
            if not good:
                text, y = f"{w()} at {w()} dot {w()}" if r.random() < 0.5 else f"{w()} at {w()}.{r.choice(['com', 'txt', w(), w()])}", 0
            front = r.choice([front, w(), w()])
        elif kind == "phone":
            text = phone()
            # Without a telling word in front, brackets or a leading 00 tell.
            y = int(front in near["phone"] or ((text[0] == "(" or text.startswith("00")) and front not in near["other"]))
            if r.random() < 0.15:
                text, y = f"{r.choice(['19', '20'])}{d(2)}{r.choice('-./ ')}{d(2)}{r.choice('-./ ')}{d(2)} {d(2)}", 0
        elif kind == "ip":
            if r.random() < 0.6:
                text, y = r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4)), 1
            elif r.random() < 0.5:
                text, y = ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)), 1
            else:
                text, y = ":".join(d(2) for _ in range(8)), 0
        else:
            text = digits((4, 4, 4, 4) if r.random() < 0.8 else (4, 4, 4, 3), "./-_")
            y = int(front in near["card"])
        out.append((" ".join(x for x in (words(0, 4), front, text, words(0, 3)) if x), y))
    return out


_FITTED: dict[int, Trees] = {}


def fitted(spark: SparkSession, seed: int = 11) -> Trees:
    """Trees for the made-up lines of a seed: candidates and features come from the same expressions as for documents."""
    if seed not in _FITTED:
        df = spark.createDataFrame([(t, y) for t, y in made_up(seed)], "text string, y int")
        found = df.withColumn("base", base_spans(F.col("text"))).select("y", F.explode(candidates(F.col("text"), F.col("base"))).alias("c"))
        rows = found.select("y", *[F.col(f"c.{n}").alias(n) for n in FEATURES]).toPandas()
        _FITTED[seed] = Trees(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy())
    return _FITTED[seed]


_SCORED = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _apart(spans: Column) -> Column:
    """Of spans with scores those that stay: the likeliest first (then the earlier), each unless one that stays overlaps it.

    Spans are taken in order of their starts, run by run of overlapping ones; only within a run each is compared with what stays there.
    """
    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    ranked = lambda run: F.array_sort(F.transform(run, lambda c: F.struct((-c["score"]).alias("o"), c["start"].alias("start"), c["rank"].alias("rank"), c.alias("c"))))
    stay = lambda run: F.aggregate(F.transform(ranked(run), lambda x: x["c"]), F.array().cast(_SCORED), lambda acc, c: F.when(F.exists(acc, lambda o: clash(o, c)), acc).otherwise(F.array_append(acc, c)))
    state = lambda end, run, out: F.struct(end.alias("end"), run.alias("run"), out.alias("out"))

    def step(acc, c):
        closed = state(c["end"], F.array(c), F.concat(acc["out"], stay(acc["run"])))
        return F.when(c["start"] >= acc["end"], closed).otherwise(state(F.greatest(acc["end"], c["end"]), F.array_append(acc["run"], c), acc["out"]))

    none = F.array().cast(_SCORED)
    return F.aggregate(F.array_sort(spans), state(F.lit(0), none, none), step, lambda acc: F.concat(acc["out"], stay(acc["run"])))


def with_spans(docs: DataFrame, seed: int = 11) -> DataFrame:
    """docs and two columns more: base and spans, arrays of struct<start, rank, end, kind> by start, then kind (KINDS' order).

    start and end count code points, end is exclusive. base: the leftmost non-overlapping matches of each kind's pattern that pass its test. spans:
    base, and the candidates that the trees accept; of accepted ones that overlap the likelier stays, then the earlier, and one gives way only to one that
    stays itself. A text of any length is read whole. A null text is empty and
    gives empty arrays; so does a text without personal data. Columns named base or spans are replaced.
    """
    trees = fitted(docs.sparkSession, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = lambda c: F.struct(*[c[n].alias(n) for n in ("start", "rank", "end", "kind")])
    cut = lambda c: F.element_at(F.array(*map(F.lit, trees.cut)), c["rank"] + 1)
    scored = F.transform("__c", lambda c: F.struct(*[c[n].alias(n) for n in ("start", "rank", "end", "kind")], trees.column(c).alias("score")))
    out = docs.withColumn("base", base_spans(text)).withColumn("__c", candidates(text, F.col("base")))
    out = out.withColumn("__c", F.when(F.size("__c") > 0, F.filter(scored, lambda c: c["score"] >= cut(c))))
    best = F.transform(_apart(F.col("__c")), slim)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(best, none)))).drop("__c")


def digest(spans) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins within an earlier one goes with it."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
