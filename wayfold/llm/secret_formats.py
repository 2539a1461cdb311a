"""Secret scans: base patterns, and formats learned from them by grammar inference.

The spans of the base patterns are the labelled credentials.  Per kind a prefix tree over
character classes is built from them and its statistically compatible states are merged
(Hoeffding test on stop and transition frequencies), which leaves a probabilistic automaton
of the format; the runs outside all spans give one of ordinary text in the same way.  Every run of ``LEAST`` and more
credential characters outside the base spans is scored, whatever it is made of, by its log likelihood under each
format's automaton over that under the ordinary one.  It becomes a span of its own where it is as much more likely
as labelled credentials left out of the fit are, and by ``ODDS`` at least.

Everything is learned from all texts.  ``labelled`` counts the formats (class sequences) of all distinct credentials and
of all ordinary runs.  ``fit`` reads that table: prefixes of formats are counted by grouped aggregations, depth by depth,
and a state of the prefix tree stands where at least ``EVIDENCE`` credentials pass and one in ``ODDS / 5`` of its kind, so
the driver holds at most that many states a depth; a step that rarer ones take leads back to the first state.  Once states
are merged, all formats walk the automaton in tasks and every step is counted; then all are scored in tasks for the
thresholds, of which the driver gets counts of scores at four digits.  ``scan`` reads every text once more.

Defined cases: a null or blank text holds no span; without a labelled credential of a kind
there is no automaton for it and only base spans are found; repeated rows are scanned each; a null id is kept;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import map_batches
from wayfold.session import discard, materialize

# The base patterns in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run that is too short fails as a whole, so the least length may stand in these two patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6

#: Runs that the automata judge, from the least length of an assigned credential on.
LEAST = ASSIGN_MIN
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PLAIN = "plain"
#: How many times likelier a run must be as a credential than as ordinary text; of so many ordinary runs one may be as likely.
ODDS = 1000
#: Runs whose verdict a task keeps, none longer than LONG; a full cache is emptied.
CACHE, LONG = 400_000, 64
#: Formats that a task counts before it hands them on, and their characters.
FORMATS, CHARACTERS = 200_000, 1 << 25
#: Significance of the merge test; the least visits at which a state's frequencies count as evidence, and the least share of its kind's.
ALPHA, EVIDENCE, SHARE = 0.05, 10, 5 / ODDS
#: Depths of the prefix trees that are counted at once.
DEPTHS = 8
#: Share of labelled credentials, left out of the fit, that may score below the threshold.
MISSED = 0.02


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of the candidate runs, without what a base span covers of them."""
    edges = [(s, e) for s, _, e in base]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if edges:
            for s, e in edges:
                if s < end and start < e:
                    if s - start >= LEAST:
                        yield start, s
                    start = max(start, e)
        if end - start >= LEAST:
            yield start, end


def _classes() -> dict[str, str]:
    """Class of each credential character: a hex letter, another letter, a digit, or itself."""
    out = {c: c for c in "+/_.=-"}
    for low, high, name in (("a", "f", "h"), ("g", "z", "l"), ("A", "F", "H"), ("G", "Z", "U"), ("0", "9", "d")):
        out.update({chr(c): name for c in range(ord(low), ord(high) + 1)})
    return out


CLASS = _classes()
CLASSES = str.maketrans(CLASS)


def form_of(word: str) -> str:
    """The format of a run: the class of each character."""
    return word.translate(CLASSES)


@dataclass
class Node:
    visits: int = 0
    stops: int = 0
    next: dict[str, "Node"] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=dict)


def prefix_tree(words: list[str]) -> Node:
    root = Node()
    for word in words:
        node = root
        node.visits += 1
        for symbol in form_of(word):
            node.count[symbol] = node.count.get(symbol, 0) + 1
            node = node.next.setdefault(symbol, Node())
            node.visits += 1
        node.stops += 1
    return root


def _differ(a: int, n: int, b: int, m: int) -> bool:
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: Node, b: Node) -> bool:
    """Whether two states and all that follows them behave alike, as far as there is evidence."""
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        if x is y or x.visits < EVIDENCE or y.visits < EVIDENCE:
            continue
        if _differ(x.stops, x.visits, y.stops, y.visits):
            return False
        for symbol in {*x.count, *y.count}:
            if _differ(x.count.get(symbol, 0), x.visits, y.count.get(symbol, 0), y.visits):
                return False
            if symbol in x.next and symbol in y.next:
                pairs.append((x.next[symbol], y.next[symbol]))
    return True


def fold(red: Node, blue: Node) -> None:
    """Add a subtree to a state; the blue side is still a tree, so this ends."""
    pairs = [(red, blue)]
    while pairs:
        x, y = pairs.pop()
        x.visits += y.visits
        x.stops += y.stops
        for symbol, n in y.count.items():
            x.count[symbol] = x.count.get(symbol, 0) + n
            if symbol not in y.next:
                continue  # too rare for a state
            if symbol in x.next:
                pairs.append((x.next[symbol], y.next[symbol]))
            else:
                x.next[symbol] = y.next[symbol]


def merge(root: Node) -> list[Node]:
    """The states that remain of a prefix tree when those that behave alike are one."""
    red = [root]
    while True:
        known = {id(r) for r in red}
        blue = [(r, s, n) for r in red for s, n in r.next.items() if id(n) not in known]
        if not blue:
            return red
        owner, symbol, node = max(blue, key=lambda x: (x[2].visits, x[1]))
        into = next((r for r in red if compatible(r, node)), None)
        if into is None:
            red.append(node)
        else:
            owner.next[symbol] = into
            fold(into, node)


def targets(red: list[Node]) -> list[dict[str, int]]:
    """Per state: where its steps lead."""
    place = {id(r): k for k, r in enumerate(red)}
    return [{s: place[id(n)] for s, n in r.next.items()} for r in red]


def automaton_of(steps: list[dict[str, int]], counts: list[dict[str, int]]) -> list[dict]:
    """Stop and transition log probabilities and targets; ``counts`` has a state's steps by symbol and its stops under ''."""
    width = len(set(CLASS.values())) + 1
    out = []
    for go, n in zip(steps, counts):
        visits = sum(n.values()) + width
        out.append({"stop": math.log((n.get("", 0) + 1) / visits), "other": math.log(1 / visits),
                    "go": {s: (math.log((k + 1) / visits), go.get(s, 0)) for s, k in n.items() if s}})
    return out


def infer(words: list[str]) -> list[dict]:
    """The automaton of a few words."""
    red = merge(prefix_tree(words))
    return automaton_of(targets(red), [{**r.count, "": r.stops} for r in red])


def form_likelihood(automaton: list[dict], form: str) -> float:
    """Log probability; an unknown step costs the smoothed rest and stays in its state."""
    total, state = 0.0, 0
    for symbol in form:
        cost, state = automaton[state]["go"].get(symbol, (automaton[state]["other"], state))
        total += cost
    return total + automaton[state]["stop"]


def likelihood(automaton: list[dict], word: str) -> float:
    return form_likelihood(automaton, form_of(word))


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, form, half, n): formats of all distinct credentials, by the half their hash puts them in, and of all ordinary runs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "form", "place", "n"]
        plain: Counter[str] = Counter()
        size = 0
        for batch in batches:
            found = set()
            for t in batch["text"]:
                t = t or ""
                base = base_spans(t)
                for start, kind, end in base:
                    value = _value(kind, t[start:end])
                    found.add((KINDS[kind], form_of(value), _place(value), 1))
                for s, e in runs(t, base):
                    form = form_of(t[s:e])
                    if form not in plain:
                        size += len(form)
                    plain[form] += 1
                if len(plain) > FORMATS or size > CHARACTERS:
                    yield pd.DataFrame([(PLAIN, form, 0, n) for form, n in plain.items()], columns=columns)
                    plain.clear()
                    size = 0
            yield pd.DataFrame(sorted(found), columns=columns)
        yield pd.DataFrame([(PLAIN, form, 0, n) for form, n in plain.items()], columns=columns)

    rows = map_batches(docs.select(F.col(text).alias("text")), run, "kind string, form string, place long, n long")
    values = rows.groupBy("kind", "form", "place").agg(F.sum("n").alias("n"))
    return values.groupBy("kind", "form", (F.col("place") % 2).cast("int").alias("half")).agg(
        F.sum(F.when(F.col("kind") == PLAIN, F.col("n")).otherwise(1)).alias("n"))


def _place(value: str) -> int:
    return xxhash.xxh64_intdigest(value) >> 1


def _value(kind: int, span: str) -> str:
    return ASSIGN.match(span).group(2) if kind == 0 else span


class Ordinary:
    """Ordinary runs: half their automaton, half the formats as they stand that one in ODDS of them has (dates, for one),
    of which a merged automaton keeps little."""

    def __init__(self, automaton: list[dict], shares: dict[str, float]):
        self.automaton = automaton
        self.formats = {form: math.log(0.5 * share) for form, share in shares.items()}

    def likelihood(self, form: str) -> float:
        merged = math.log(0.5) + form_likelihood(self.automaton, form)
        known = self.formats.get(form, -math.inf)
        return max(merged, known) + math.log1p(math.exp(-abs(merged - known)))


def prefix_trees(forms: DataFrame, least: dict[str, float]) -> dict[str, Node]:
    """Per kind the prefix tree of its formats down to where fewer than ``least`` pass; its counts are of all formats.

    ``DEPTHS`` depths are counted by one aggregation, of the formats whose beginning is in the tree so far.
    """
    if not least:
        return {}
    bar = F.create_map(*[F.lit(x) for kind, n in least.items() for x in (kind, float(n))])[F.col("kind")]
    trees, depth, rows = {kind: Node() for kind in least}, 0, forms
    while True:
        at = F.explode(F.sequence(F.lit(depth), F.least(F.length("form"), F.lit(depth + DEPTHS - 1)))).alias("at")
        steps = (rows.select("kind", "form", "n", at)
                 .groupBy("kind", F.substring("form", F.lit(1), F.col("at")).alias("prefix"), F.substring("form", F.col("at") + 1, F.lit(1)).alias("symbol"))
                 .agg(F.sum("n").alias("n")).groupBy("kind", "prefix")
                 .agg(F.sum("n").alias("visits"), F.collect_list(F.struct("symbol", "n")).alias("steps")).where(F.col("visits") >= bar))
        further = []
        for r in sorted(steps.collect(), key=lambda r: len(r["prefix"])):  # at most 1 / SHARE a depth and kind
            node = trees[r["kind"]]
            for symbol in r["prefix"]:
                node = node.next.setdefault(symbol, Node())
            count = {s["symbol"]: s["n"] for s in r["steps"]}
            node.visits, node.stops = r["visits"], count.pop("", 0)
            node.count = dict(sorted(count.items()))
            if len(r["prefix"]) == depth + DEPTHS - 1:
                further += [(r["kind"], r["prefix"] + s) for s, n in count.items() if n >= least[r["kind"]]]
        if not further:
            return trees
        depth += DEPTHS
        kept = forms.sparkSession.createDataFrame(further, "kind string, start string")
        rows = (forms.where(F.length("form") >= depth).withColumn("start", F.substring("form", 1, depth))
                .join(F.broadcast(kept), ["kind", "start"], "left_semi"))


def walked(forms: DataFrame, steps: dict[str, list[dict[str, int]]]) -> dict[str, list[dict]]:
    """Per kind the automaton whose probabilities come from all formats' walks; a step that leads nowhere leads to the first state."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            for kind, form, n in zip(batch["kind"], batch["form"], batch["n"]):
                go, state = steps[kind], 0
                for symbol in form:
                    counts[kind, state, symbol] += n
                    state = go[state].get(symbol, 0)
                counts[kind, state, ""] += n
        yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["kind", "state", "symbol", "n"])

    counts = {kind: [{} for _ in go] for kind, go in steps.items()}
    rows = map_batches(forms.select("kind", "form", "n"), run, "kind string, state int, symbol string, n long")
    for r in rows.groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n")).collect():  # a row a state and symbol
        counts[r["kind"]][r["state"]][r["symbol"]] = r["n"]
    return {kind: automaton_of(go, counts[kind]) for kind, go in steps.items()}


def digits(score: float, up: bool) -> float:
    """Four digits of a score above the least that counts, rounded up or down."""
    if score <= math.log(ODDS):
        return math.log(ODDS)
    unit = 10.0 ** (math.floor(math.log10(score)) - 3)
    return (math.ceil(score / unit) if up else math.floor(score / unit)) * unit


def quantile(counts: dict[float, int], place: int) -> float:
    """The value at a place of the sorted values."""
    for value, n in sorted(counts.items()):
        place -= n
        if place < 0:
            return value
    raise ValueError("fewer values")


def scores_of(forms: DataFrame, plain: Ordinary, automata: dict[str, list[dict]]) -> dict[tuple[str, bool], dict[float, int]]:
    """Per kind, how many formats of its own (held) and of the ordinary ones have each score, at four digits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, bool, float]] = Counter()
        for batch in batches:
            for kind, form, n in zip(batch["kind"], batch["form"], batch["n"]):
                ordinary = plain.likelihood(form)
                for k in automata if kind == PLAIN else [kind]:
                    counts[k, kind == PLAIN, digits(form_likelihood(automata[k], form) - ordinary, kind == PLAIN)] += n
        yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["kind", "ordinary", "score", "n"])

    out = {(kind, ordinary): {} for kind in automata for ordinary in (False, True)}
    rows = map_batches(forms.select("kind", "form", "n"), run, "kind string, ordinary boolean, score double, n long")
    for r in rows.groupBy("kind", "ordinary", "score").agg(F.sum("n").alias("n")).collect():  # at most 9,000 a power of ten
        out[r["kind"], r["ordinary"]][r["score"]] = r["n"]
    return out


def fit(found: DataFrame) -> dict[str, tuple[list[dict], float]]:
    """Per kind: the automaton and the least score; and the ordinary automaton.

    A score must be one that all but MISSED of the credentials left out of the fit have, that is ODDS to one, and that
    at most one in ODDS of the ordinary runs has.  A kind whose credentials all fall in one half has none left out.
    """
    forms = materialize(found, "formats")
    totals = {(r["kind"], r["half"]): r["n"] for r in forms.groupBy("kind", "half").agg(F.sum("n").alias("n")).collect()}
    halves = {kind: [h for h in (0, 1) if (kind, h) in totals] for kind in (*KINDS, PLAIN)}
    whole = F.col("kind").isin([kind for kind, h in halves.items() if len(h) < 2])
    learn = forms.where(whole | (F.col("half") == 0))
    least = {kind: max(EVIDENCE, SHARE * totals[kind, h[0]]) for kind, h in halves.items() if h}
    trees = prefix_trees(learn, least)
    automata = walked(learn, {kind: targets(merge(root)) for kind, root in trees.items()})
    runs_in_all = totals.get((PLAIN, 0), 0)
    usual = forms.where((F.col("kind") == PLAIN) & (F.col("n") * ODDS >= runs_in_all) & (F.col("n") > 1)).collect()  # at most ODDS
    plain = Ordinary(automata.pop(PLAIN, None) or infer([]), {r["form"]: r["n"] / runs_in_all for r in usual})
    model = {PLAIN: (plain, 0.0)}
    scores = scores_of(forms.where(whole | (F.col("half") == 1)), plain, automata) if automata else {}
    for kind, automaton in automata.items():
        held, ordinary = scores[kind, False], scores[kind, True]
        low = quantile(held, int(MISSED * sum(held.values())))
        high = quantile(ordinary, runs_in_all - 1 - runs_in_all // ODDS) if runs_in_all >= ODDS else -math.inf
        model[kind] = (automaton, max(low - 1e-9, math.log(ODDS), high + 1e-9))
    discard(forms)
    return model


class Verdicts(dict):
    """The kind that a run is as likely as, or an empty string; kept for a bounded number of runs."""

    def __init__(self, model: dict):
        super().__init__()
        self.plain, self.kinds = model[PLAIN][0], [(k, *m) for k, m in model.items() if k != PLAIN]

    def __missing__(self, run: str) -> str:
        form = form_of(run)
        ordinary = self.plain.likelihood(form) if self.kinds else 0.0
        score, kind = max(((form_likelihood(a, form) - ordinary - least, k) for k, a, least in self.kinds), default=(-1.0, ""))
        found = kind if score >= 0 else ""
        if len(run) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[run] = found
        return found


def spans_of(text: str, verdicts: Verdicts) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """Base spans, and (start, name, end) of the runs outside them whose format is as likely as a credential's."""
    base = base_spans(text)
    if not verdicts.kinds:
        return base, []
    return base, [(s, f"like_{kind}", e) for s, e in runs(text, base) if (kind := verdicts[text[s:e]])]


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts per base kind, the digest of the base spans, and all spans as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few states per kind

    def row(t: str, verdicts: Verdicts) -> tuple:
        base, more = spans_of(t, verdicts)
        shown = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        order = sorted([(s, k, x) for (s, k, _), x in zip(base, shown)]
                       + [(s, len(KINDS), f"{name}:{s}:{e}") for s, name, e in more])
        kinds = [k for _, k, _ in base]
        return (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(",".join(shown).encode()).hexdigest(),
                ",".join(x for _, _, x in order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verdicts = Verdicts(shared.value)
        for batch in batches:
            out = pd.DataFrame([row(t or "", verdicts) for t in batch["text"]],
                               columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "id", batch["id"].array)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run,
                       f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``labelled``, ``fit`` and ``scan`` over the same rows."""
    return scan(docs, fit(labelled(docs, text)), id_col, text)
