"""Personal data in texts, by weak supervision; DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns give further candidates: only forms that
ordinary prose doesn't have (a bracketed "at", a bracketed area code, a defanged address), or less sure ones with a cue right
before them, and none after a word such as "serial" or "part number". Labelers
(the strict pattern, boundaries, a gazetteer, context cues for and against, a validity check) vote
on every candidate; expectation-maximisation estimates each labeler's reliability for each kind from
the votes alone, and its posteriors train the final span classifier, a naive Bayes model over the shape and
surroundings of a span. A candidate that is no base span is added when the classifier finds it likely.

Vote patterns and features have fixed, small value sets, so the tables of the model don't grow with
the corpus; counts cover all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import drop, store

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
#: Possessive groups run without recursion, and the look-behind saves retries inside a run: same matches as the plain forms.
STRICT = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Fixed word lists of the context labelers.
CUES = {
    "email": ["mail", "contact", "write", "correo", "courriel", "reach"],
    "ip": ["ip", "host", "server", "address", "login", "ping"],
    "card": ["card", "visa", "master", "credit", "pay", "karte", "tarjeta", "carte"],
    "phone": ["phone", "tel", "call", "fax", "mobile", "cell", "dial"],
}
AGAINST = ["version", "section", "isbn", "issn", "chapter", "figure", "table", "order", "page", "serial", "doi", "part", "item", "model", "invoice", "sku", "ref", "reference", "id", "ticket", "account"]
_filler = r"(?:\x20(?:to|me|us|is|at|on|no|number))?"
_right_before = lambda kind: rf"(?<=(?i:{'|'.join(CUES[kind])}){_filler}{_filler}\.?:?\x20?)"
_bracketed = lambda word: "(?:" + "|".join(rf"\{a}(?i:{word})\{b}" for a, b in ("()", "[]", "{}")) + ")"
_DOMAIN = rf"[A-Za-z0-9-]++(?:(?:\.|\x20?{_bracketed('dot')}\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++"
LOOSE = {
    # A bare "at" or an @ between blanks needs a cue and a local part that is no word.
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?{_bracketed('at')}\x20?{_DOMAIN}|(?<![{LOCAL}])(?=[{LOCAL}]++\x20(?:@|(?i:at))\x20)(?=[{LOCAL}]*[A-Za-z])(?=[{LOCAL}]*[0-9._+-]){_right_before('email')}[{LOCAL}]++\x20(?:@|(?i:at))\x20{_DOMAIN}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::[0-9A-Fa-f]{1,4}){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20?\[dot\]\x20?)[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20?\[dot\]\x20?)[0-9]{1,3}){2}(?![0-9])",
    "card": r"(?<![0-9])3(?:[\x20-]?[0-9]){13,14}+(?![0-9])|(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    # Ten digits need a bracketed area code or a cue.
    "phone": rf"(?<![0-9+(])\([0-9]{{3}}\)[\x20-]?[0-9]{{3}}[\x20.-][0-9]{{4}}(?![0-9])|(?=[0-9]{{3}}[\x20.-][0-9]{{3}}[\x20.-]){_right_before('phone')}[0-9]{{3}}[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}(?![0-9])|(?<![0-9+])00[1-9][0-9]{{0,2}}(?:[\x20.()-]{{1,2}}[0-9]{{2,4}}){{2,4}}(?![0-9])",
}
#: What a text must hold for the pattern to be tried: a plain text, or a quicker pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
LOOSE_NEEDS = {
    "email": r"[(\[{](?i:at)[)\]}]|\x20(?:@|(?i:at))\x20",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9]\x20?[\[(](?:\.|dot)[\])]",
    "card": r"3[0-9\x20-]{13}|[0-9]{4}[./_][0-9]{4}[./_]",
    "phone": r"\([0-9]{3}\)|00[1-9]|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
#: The gazetteer's default tables; with_candidates takes others. Top domains of addresses, first digits of card
#: issuers, calling codes after + or 00, and first groups of addresses in use.
GAZETTEER = {
    "email": [
        *["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "tv", "ai", "app", "dev", "cloud", "online", "shop", "site", "xyz"],
        *["ar", "at", "au", "be", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "es", "eu", "fi", "fr", "gr", "hk", "hu", "ie", "il", "in", "it", "jp", "kr"],
        *["mx", "nl", "no", "nz", "pl", "pt", "ro", "ru", "se", "sg", "tr", "tw", "ua", "uk", "us", "za"],
    ],
    "card": ["2[2-7]", "3[4-7]", "4", "5[0-8]", "6[0-9]"],
    "phone": ["1", "20", "27", "3[0-469]", "4[013-9]", "5[1-8]", "6[0-6]", "7", "8[1246]", "9[0-58]", "[2-9][0-9]{2}"],
    "ip": ["[1-9]", "[1-9][0-9]", "1[0-9]{2}", "2[0-3][0-9]", "2[0-9a-fA-F]{3}:.*", "3[0-9a-fA-F]{3}:.*", "f[cdeCDE][0-9a-fA-F]{2}:.*"],
}
LABELERS = ["strict", "bounded", "gazetteer", "cue", "against", "valid"]
ROUNDS = 15
BEFORE, AFTER = 32, 8  # code points of context
LIKELY = 0.9
FEATURE_VALUES = 10  # of a feature, for smoothing

SPAN = "struct<kind:string,start:int,end:int,base:boolean>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, needs: str, plain: bool = True) -> Column:
    """array<struct<start, end, m, before, after>>: all matches with their code point offsets and what is next to them.

    before and after are the last and first code points of the text between this match and its neighbours of the kind. Offsets are
    running sums. They are taken over blocks of about the root of the number of matches, and then within
    each block, so that a text with very many matches isn't copied once for each of them.
    """
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,m:string,before:string,after:string>>)")

    def beside(both):
        n = F.size(both["found"])
        sides = F.zip_with(F.slice(both["parts"], F.lit(1), n), F.slice(both["parts"], F.lit(2), n), lambda left, right: F.struct(F.length(left).alias("gap"), F.right(left, F.lit(BEFORE)).alias("before"), F.left(right, F.lit(AFTER)).alias("after")))
        return F.zip_with(sides, both["found"], lambda side, m: F.struct(side["gap"].alias("gap"), m.alias("m"), side["before"].alias("before"), side["after"].alias("after")))

    def starts(blocks):
        begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
        width = lambda block: F.aggregate(block, F.lit(0), lambda sum_, x: sum_ + x["gap"] + F.length(x["m"]))
        ahead = F.aggregate(blocks, begin, lambda state, block: F.struct((state["at"] + width(block)).alias("at"), F.array_append(state["out"], state["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, ahead, placed))

    def placed(block, at):
        def step(state, x):
            start = state["at"] + x["gap"]
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    tried = text.rlike(pattern)
    if needs:
        tried = (text.contains(needs) if plain else text.rlike(needs)) & tried
    both = F.struct(parts.alias("parts"), found.alias("found"))
    return F.when(tried, _let(_let(_let(both, beside), _blocks), starts)).otherwise(none)


def _blocks(items: Column) -> Column:
    """An array as an array of about as many consecutive parts as each has elements."""

    def sliced(items):
        side = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(items) / side).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * side + 1, side))

    return _let(items, sliced)


def _fold(items: Column, state: Column, step, out_type: str) -> Column:
    """array<out_type>: what step(state, item) -> (state, array to add) adds, one item after another, block by block."""
    none = F.expr(f"CAST(array() AS array<{out_type}>)")
    nested = F.expr(f"CAST(array() AS array<array<{out_type}>>)")
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(held, item):
        def both(held):
            after, more = step(held["state"], item)
            return pair(after, F.when(F.size(more) > 0, F.concat(held["out"], more)).otherwise(held["out"]))

        return _let(held, both)

    def block(held, own):
        return _let(F.aggregate(own, pair(held["state"], none), one), lambda done: pair(done["state"], F.array_append(held["out"], done["out"])))

    return F.flatten(F.aggregate(_blocks(items), pair(state, nested), block)["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def worth(i):
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _plausible(kind: str, m: Column) -> Column:
    """The validity labeler: of candidates that need not be base spans."""
    digits = _digits(m)
    if kind == "ip":
        return F.when(m.contains(":"), F.size(F.split(m, ":")).between(3, 8) & (m.contains("::") | (F.size(F.split(m, ":")) == 8))).otherwise(_valid("ip", F.regexp_replace(m, r"\x20?[\[(](?:\.|dot)[\])]\x20?", ".")))
    if kind == "card":  # 14 and 15 digits have issuers of their own
        known = F.when(F.length(digits) == 14, digits.rlike("^3[0689]")).when(F.length(digits) == 15, digits.rlike("^3[47]")).otherwise(F.length(digits).between(16, 19))
        return F.when(known, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.when(digits.startswith("00"), F.length(digits).between(11, 17)).otherwise(F.length(digits).between(8, 15)) & (F.length(F.regexp_replace(digits, F.substr(digits, F.lit(1), F.lit(1)), F.lit(""))) > 2)
    return m.rlike(r"(?i)(\.|dot\W{1,2})[a-z]{2,}$")


def _after_other(before: Column) -> Column:
    """Whether the words right before say that a number is something else."""
    return F.lower(before).rlike(rf"\b(?:{'|'.join(AGAINST)})s?(?:\W+(?:number|numbers|no|nr|code))?\W*$")


def _eligible(kind: str, x: Column, listed: list[str]) -> Column:
    """Of loose matches, those that may become candidates at all."""
    fits = _plausible(kind, x["m"]) & ~_after_other(x["before"])
    if kind == "email":
        return fits & (x["m"].rlike(_bracketed("at")) | _gazetteer(kind, x["m"], listed))
    if kind == "phone":
        return fits & _gazetteer(kind, x["m"], listed)
    return fits


def _gazetteer(kind: str, m: Column, listed: list[str]) -> Column:
    any_of = "|".join(listed)
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(listed)
    if kind == "card":
        return m.rlike(f"^({any_of})")
    if kind == "phone":
        return F.when(m.rlike(r"^(\+|00)"), m.rlike(rf"^(\+|00)\x20?\(?({any_of})")).otherwise(m.rlike(r"^\(?[2-9][0-9]{2}"))
    return m.rlike(rf"^({any_of})([.\[(\x20]|$)")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _votes(kind: str, x: Column, listed: list[str]) -> Column:
    """1 for, 0 against, -1 no vote; in the order of LABELERS. The strict patterns vote for what they match only."""
    before = F.lower(x["before"])
    return F.array(
        F.when(x["base"], 1).otherwise(-1),
        _flag(~F.substr(x["before"], F.length(x["before"]), F.lit(1)).rlike("[A-Za-z0-9]") & ~x["after"].rlike("^[A-Za-z0-9]")),
        _flag(_gazetteer(kind, x["m"], listed)),
        F.when(before.rlike(rf"\b({'|'.join(CUES[kind])})"), 1).otherwise(-1),
        F.when(_after_other(before), 0).otherwise(-1),
        _flag(_plausible(kind, x["m"])),
    )


def _features(x: Column, known: Column, plausible: Column) -> Column:
    """Names of the span's features: from value sets of fixed size. known and plausible are votes."""
    side = lambda c: F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("mark")
    left = F.substr(x["before"], F.length(x["before"]), F.lit(1))
    word = F.lower(F.regexp_extract(x["before"], r"([\p{L}]+)[^\p{L}]*$", 1))
    return F.array(
        F.concat(F.lit("length "), F.least(F.length(x["m"]), F.lit(40))),
        F.concat(F.lit("digits "), F.least(F.length(_digits(x["m"])), F.lit(20))),
        F.concat(F.lit("marks "), F.least(F.length(F.regexp_replace(x["m"], "[A-Za-z0-9]", "")), F.lit(10))),
        F.concat(F.lit("left "), side(left)),
        F.concat(F.lit("right "), side(F.substr(x["after"], F.lit(1), F.lit(1)))),
        F.concat(F.lit("word "), F.pmod(F.xxhash64(word), F.lit(64))),
        F.concat(F.lit("known "), known.cast("string")),
        F.concat(F.lit("plausible "), plausible.cast("string")),
    )


def _context(m: Column, base: bool) -> Column:
    return F.struct(F.lit(base).alias("base"), m["m"].alias("m"), m["before"].alias("before"), m["after"].alias("after"))


def _named(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["m"].alias("m"), m["before"].alias("before"), m["after"].alias("after")))


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,m,before,after>>: the strict patterns' valid matches, by kind and start."""

    def valid(kind):
        return F.filter(_matches(text, STRICT[kind], NEEDS[kind]), lambda m: _valid(kind, m["m"]))

    return F.concat(*(_named(kind, valid(kind)) for kind in KINDS))


def _described(spans: Column, base: bool, gazetteer: dict[str, list[str]]) -> Column:
    def votes(kind, x):
        return reduce(lambda rest, k: F.when(kind == k, _votes(k, x, gazetteer[k])).otherwise(rest), KINDS[1:], _votes(KINDS[0], x, gazetteer[KINDS[0]]))

    def one(m):
        def parts(x):
            known, plausible = LABELERS.index("gazetteer"), LABELERS.index("valid")
            described = lambda v: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(base).alias("base"), v.alias("votes"), _features(x, v[known], v[plausible]).alias("features"))
            return _let(votes(m["kind"], x), described)

        return _let(_context(m, base), parts)

    return F.transform(spans, one)


def candidate_spans(text: Column, gazetteer: dict[str, list[str]] | None = None) -> Column:
    """struct<base, cands>: the base spans, and all candidates (kind, start, end, base, votes, features)."""

    listed = GAZETTEER | (gazetteer or {})

    def loose(kind):
        return F.filter(_matches(text, LOOSE[kind], LOOSE_NEEDS[kind], plain=False), lambda m: _eligible(kind, m, listed[kind]))

    def with_base(base):
        looser = F.concat(*(_named(kind, loose(kind)) for kind in KINDS))
        # A loose span is compared with the reach of blocks of base spans, and with the spans of blocks that it touches.
        by_start = F.array_sort(base, lambda a, b: a["start"] - b["start"])
        reach = lambda block: F.struct(F.element_at(block, 1)["start"].alias("start"), F.array_max(F.transform(block, lambda b: b["end"])).alias("end"), block.alias("own"))
        touches = lambda a, x: (a["start"] < x["end"]) & (x["start"] < a["end"])

        def split(loose):
            apart = lambda blocks: F.filter(loose, lambda x: ~F.exists(blocks, lambda k: touches(k, x) & F.exists(k["own"], lambda b: touches(b, x))))
            kept = F.when(F.size(loose) == 0, loose).when(F.size(base) == 0, loose).otherwise(_let(F.transform(_blocks(by_start), reach), apart))
            return _let(kept, lambda kept: F.struct(base.alias("base"), F.concat(_described(base, True, listed), _described(kept, False, listed)).alias("cands")))

        return _let(looser, split)

    return _let(base_spans(text), with_base)


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def with_candidates(docs: DataFrame, gazetteer: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds _found, the candidate spans of text, where it is not there yet. Store the result to search the texts once.

    gazetteer replaces the default table of the kinds it names: top domains (email), or patterns of how the span begins.
    A null text has none; texts with very many matches are searched in blocks of them, in about the number's power of 1.5.
    """
    return docs if "_found" in docs.columns else docs.withColumn("_found", candidate_spans(_whole("text"), gazetteer))


def _posterior(votes: Column, sensitivity: Column, specificity: Column, prior: Column) -> Column:
    """Chance that a span with these votes is real, for labelers that are independent given whether it is."""
    rates = F.zip_with(sensitivity, specificity, lambda sens, spec: F.struct(sens.alias("sens"), spec.alias("spec")))

    def weigh(v, r):
        return F.when(v == 1, F.log(r["sens"] / (1 - r["spec"]))).when(v == 0, F.log((1 - r["sens"]) / r["spec"])).otherwise(0.0)

    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(votes, rates, weigh), F.log(prior / (1 - prior)), lambda a, b: a + b)))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, sensitivity array<double>, specificity array<double>, prior): by expectation-maximisation over vote
    patterns (kind, votes, n).

    A labeler has a chance to vote for a real span and one to vote against another, so one that always votes the
    same says nothing. There are at most 3 ** labelers patterns of a kind, so a kind's patterns fit in one row.
    """
    rows = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("seen"))
    begin = F.array([F.lit(0.8)] * len(LABELERS))
    start = F.struct(begin.alias("sensitivity"), begin.alias("specificity"), F.lit(0.5).alias("prior"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    inside = lambda x: F.least(F.greatest(x, F.lit(0.01)), F.lit(0.99))

    def improve(state, _):
        p = lambda s: _posterior(s["votes"], state["sensitivity"], state["specificity"], state["prior"])
        judged = F.transform("seen", lambda s: F.struct(s["votes"].alias("votes"), s["n"].alias("n"), p(s).alias("p")))

        def better(judged):
            def rate(j, vote, chance):
                cast = F.filter(judged, lambda s: s["votes"][j] >= 0)
                agree = total(F.transform(cast, lambda s: s["n"] * chance(s) * F.when(s["votes"][j] == vote, 1.0).otherwise(0.0)))
                return inside((agree + 0.8) / (total(F.transform(cast, lambda s: s["n"] * chance(s))) + 1.0))

            labelers = range(len(LABELERS))
            share = (total(F.transform(judged, lambda s: s["n"] * s["p"])) + 1) / (total(F.transform(judged, lambda s: s["n"])) + 2)
            return F.struct(
                F.array(*(rate(j, 1, lambda s: s["p"]) for j in labelers)).alias("sensitivity"),
                F.array(*(rate(j, 0, lambda s: 1 - s["p"]) for j in labelers)).alias("specificity"),
                inside(share).alias("prior"),
            )

        return _let(judged, better)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve)
    return rows.select("kind", fitted.alias("fitted")).select("kind", "fitted.*")


def fit(docs: DataFrame) -> DataFrame:
    """One stored row (weights map<string,double>): log-odds of each feature of each kind, from all documents."""
    # The outer form keeps Spark from testing each text's candidates before it computes them again.
    cands = with_candidates(docs).select(F.explode_outer("_found.cands").alias("c")).where("c IS NOT NULL").select("c.kind", "c.votes", "c.features")
    counted = store(cands.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "votes")
    fitted = reliabilities(counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    chance = _posterior(F.col("votes"), F.col("sensitivity"), F.col("specificity"), F.col("prior"))
    judged = counted.join(F.broadcast(fitted), "kind").withColumn("p", chance)  # one row for each kind
    each = judged.select("kind", F.explode(F.array_append("features", F.lit("all"))).alias("feature"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    sums = each.groupBy("kind", "feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    whole = sums.where("feature = 'all'").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    share = lambda part, all_: (F.col(part) + 0.5) / (F.col(all_) + 0.5 * FEATURE_VALUES)
    prior = F.log((F.col("all_yes") + 0.5) / (F.col("all_no") + 0.5))
    weight = F.when(F.col("feature") == "all", prior).otherwise(F.log(share("yes", "all_yes") / share("no", "all_no")))
    table = sums.join(F.broadcast(whole), "kind").select(F.concat("kind", F.lit(" "), "feature").alias("name"), weight.alias("weight"))
    model = store(table.agg(F.map_from_entries(F.collect_list(F.struct("name", "weight"))).alias("weights")), "weights")
    drop(counted)
    return model


def find_spans(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Adds spans, array<struct<kind,start,end,base>> by kind and start, to docs (text and any other columns).

    Offsets are code points, ends exclusive. Base spans always stay; others are added when they overlap no
    base span and no added span before them. A null text is empty and has none; very long texts are searched
    whole. Each row stands alone, so ties and repeated rows need no rule; an empty table gives an empty
    result. Columns named spans, _weights and _one are replaced or dropped.
    """
    model = model.select(F.col("weights").alias("_weights"), F.lit(0).alias("_one"))
    found = with_candidates(docs).drop("spans", "_weights", "_one").withColumn("_one", F.lit(0)).join(F.broadcast(model), "_one", "left").drop("_one")  # one row, of features of fixed number
    return found.withColumn("spans", _let(F.col("_found"), _decided)).drop("_weights", "_found")


def _decided(found: Column) -> Column:
    """The base spans, and the likely candidates that overlap none of them and none before them."""
    weight = lambda c: lambda f: F.coalesce(F.element_at("_weights", F.concat(c["kind"], F.lit(" "), f)), F.lit(0.0))
    score = lambda c: F.aggregate(F.transform(F.array_append(c["features"], F.lit("all")), weight(c)), F.lit(0.0), lambda a, b: a + b)
    plain = lambda base: lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(base).alias("base"))
    likely = F.log(F.lit(LIKELY / (1 - LIKELY)))
    likely_ones = F.array_sort(F.transform(F.filter(found["cands"], lambda c: ~c["base"] & (score(c) > likely)), plain(False)), lambda a, b: a["start"] - b["start"])
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    free = lambda end, c: (F.greatest(end, F.when(c["start"] >= end, c["end"]).otherwise(end)), F.when(c["start"] >= end, F.array(c)).otherwise(none))
    added = _let(likely_ones, lambda extra: F.when(F.size(extra) > 0, _fold(extra, F.lit(0), free, SPAN)).otherwise(none))
    place = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    order = lambda a, b: F.when(a["kind"] == b["kind"], a["start"] - b["start"]).otherwise(place(a["kind"]) - place(b["kind"]))
    base = F.transform(found["base"], plain(True))  # in order already
    return F.when(F.size(found["cands"]) > F.size(found["base"]), F.array_sort(F.concat(base, added), order)).otherwise(base).cast(f"array<{SPAN}>")


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; spans may come in any order, and overlapping ones are one.

    The text is cut into the stretches of blocks of spans first, so that very many spans don't read all of it each.
    """
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), lambda a, b: a["start"] - b["start"])
    clear = "struct<gap:int,start:int,end:int,kind:string>"
    # Each span with the end of what was replaced before it; one that begins inside an earlier span only widens it.
    step = lambda end, s: (F.greatest(end, s["end"]), F.array(F.struct(end.alias("gap"), F.greatest(s["start"], end).alias("start"), F.greatest(s["end"], end).alias("end"), F.when(s["start"] >= end, s["kind"]).alias("kind"))))

    def stretch(block):
        def parts(ends):
            own = F.substr(text, ends["from"] + 1, ends["to"] - ends["from"])
            mark = lambda s: F.coalesce(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")), F.lit(""))
            cut = lambda own: F.array_join(F.transform(block, lambda s: F.concat(F.substr(own, s["gap"] - ends["from"] + 1, s["start"] - s["gap"]), mark(s))), "")
            return _let(own, cut)

        return _let(F.struct(F.element_at(block, 1)["gap"].alias("from"), F.element_at(block, -1)["end"].alias("to")), parts)

    def whole(steps):
        rest = F.substr(text, F.element_at(steps, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(_blocks(steps), stretch), ""), rest)

    return F.when(F.size(spans) > 0, _let(_fold(by_start, F.lit(0), step, clear), whole)).otherwise(text)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE]; null texts stay null."""
    searched = store(with_candidates(docs), "spans")
    found = find_spans(searched, fit(searched))
    return found.withColumn("text", masked(F.col("text"), F.col("spans"))).select(*docs.columns)
