"""Selectors as plans over a table of nodes, without a join.

A compound becomes a predicate; only elements that some compound of the selectors matches stay. Chains are worked out from
left to right: each step adds a column that says whether an element ends a prefix of the chain. Steps are windows over
sorted rows, so time grows in proportion to a page however deep or wide it is:

* descendants: of the elements before this one that end the prefix, does the largest last_id reach it? Elements nest, so
  this is a running maximum in document order.
* general siblings: does an element before this one among its parent's children end the prefix? With `split`, families are
  cut into ranges of node numbers; what a range adds up to is carried on to the ranges after it.
* children and next siblings: elements take part twice, as themselves and under the number of the one they look for.

"compat" fixes the nearest ancestor or sibling from right to left, "css" tries all. For most chains both give the same. For
the others a step asks for the nearest candidate: for siblings the last value in the window; for ancestors the number of
open candidates tells the depth at which the nearest one was opened, and it is the last one of that depth.

Prefixes that selectors have in common are steps once, and steps of a kind at the same place of their chains share a window,
so many selectors cost about as many shuffles as the longest of them. All is planned on the driver, from the selectors alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from htmlframe.functions import selectors as sel
from htmlframe.operators.dom import attr

FIELDS = ("doc_id", "node_id", "parent_id", "last_id", "el_idx", "prev_el")
#: Node numbers of a range of siblings, where families are split.
RANGE = 1 << 16


def _attribute(s: sel.Simple) -> Column:
    v = attr(s.name)
    if not s.op:
        return v.isNotNull()
    want = F.lit(s.value)
    if s.op == "=":
        found = v == want
    elif s.op == "~=":
        found = F.array_contains(F.split(F.trim(F.regexp_replace(v, r"\s+", " ")), " "), want) if s.value else F.lit(False)
    elif s.op == "|=":
        found = (v == want) | F.startswith(v, F.lit(s.value + "-"))
    elif not s.value:
        found = F.lit(False)
    else:
        found = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[s.op](v, want)
    return F.coalesce(found, F.lit(False))


def _nth(at: Column, argument: str) -> Column:
    ab = sel.nth(argument)
    if ab is None:
        return F.lit(False)
    a, b = ab
    return at == b if a == 0 else ((at - b) * (1 if a > 0 else -1) >= 0) & ((at - b) % a == 0)


def predicate(compound: sel.Compound) -> Column | None:
    """A compound as a column; None if it has a :not() with combinators."""
    parts = [_simple(s) for s in compound]
    return None if any(c is None for c in parts) else reduce(lambda a, b: a & b, parts)


def _simple(s: sel.Simple) -> Column | None:
    if s.kind == "tag":
        return F.col("tag") == s.name
    if s.kind == "universal":
        return F.lit(True)
    if s.kind == "id":
        return F.coalesce(F.col("id"), F.lit("")) == s.name
    if s.kind == "class":
        return F.array_contains("classes", s.name)
    if s.kind == "attr":
        return _attribute(s)
    i, n, ti, tn = (F.col(c) for c in ("el_idx", "el_cnt", "ty_idx", "ty_cnt"))
    plain = {"first-child": i == 1, "last-child": i == n, "only-child": n == 1, "first-of-type": ti == 1, "last-of-type": ti == tn, "only-of-type": tn == 1, "empty": F.col("is_empty"), "root": F.col("is_root")}
    if s.name in plain:
        return plain[s.name]
    if s.name in sel.PSEUDO_NTH:
        return _nth({"nth-child": i, "nth-last-child": n - i + 1, "nth-of-type": ti, "nth-last-of-type": tn - ti + 1}[s.name], s.value)
    if s.name != "not":
        return F.lit(False)
    if not s.value:
        return F.lit(True)
    try:
        chains = sel.parse(s.value)
    except sel.SelectorError:
        return F.lit(False)
    if any(len(c) > 1 for c in chains):
        return None
    inner = [predicate(c[0][1]) for c in chains]
    return None if any(p is None for p in inner) else ~reduce(lambda a, b: a | b, inner)


def nearest_matters(chain: sel.Chain) -> bool:
    """Whether fixing the nearest candidate can differ from trying all."""
    return any(chain[i][0] == " " and chain[i - 1][0] in (">", "+", "~") or chain[i][0] == "~" and chain[i - 1][0] == "+" for i in range(2, len(chain)))


#: Flags in a column: what is known of an element is bits of a few numbers, however many selectors are asked.
BITS = 60


def _flag(i: int) -> Column:
    return F.col(f"flags{i // BITS}_").bitwiseAND(F.lit(1 << i % BITS)) != 0


def _any(flags: list[int]) -> Column:
    """Whether any of some flags is set."""
    masks: dict[int, int] = {}
    for i in flags:
        masks[i // BITS] = masks.get(i // BITS, 0) | 1 << i % BITS
    return reduce(lambda a, b: a | b, [F.col(f"flags{k}_").bitwiseAND(F.lit(m)) != 0 for k, m in sorted(masks.items())])


def _set(rows: DataFrame, found: dict[int, Column]) -> DataFrame:
    """Rows with more flags, from boolean columns."""
    added: dict[str, list[Column]] = {}
    for i, c in found.items():
        added.setdefault(f"flags{i // BITS}_", []).append(F.when(c, F.lit(1 << i % BITS)).otherwise(F.lit(0)).cast("long"))
    old = set(rows.columns)
    return rows.withColumns({n: reduce(lambda a, b: a.bitwiseOR(b), ([F.col(n)] if n in old else []) + cs) for n, cs in added.items()})


@dataclass(frozen=True)
class _Step:
    """Flag `out` becomes: the compound of flag `own` matches, and `how` leads to an element that ends the prefix of flag `ends`
    and whose compound is that of flag `before`; with nearest, the nearest of those that the compound matches."""

    how: str
    nearest: bool
    before: int
    ends: int
    own: int
    out: int


def _done(rows: DataFrame, keep: list[str], found: dict[_Step, Column]) -> DataFrame:
    """Rows with the columns to keep, and a flag for each step set by what its window gives."""
    given = rows.select(*keep, *[c.alias(f"found{s.out}_") for s, c in found.items()])
    return _set(given, {s.out: _flag(s.own) & F.coalesce(F.col(f"found{s.out}_"), F.lit(False)) for s in found}).drop(*[f"found{s.out}_" for s in found])


def _descendants(rows: DataFrame, steps: list[_Step]) -> DataFrame:
    earlier = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return _done(rows, rows.columns, {s: F.max(F.when(_flag(s.ends), F.col("last_id"))).over(earlier) >= F.col("node_id") for s in steps})


def _nearest_ancestors(rows: DataFrame, steps: list[_Step]) -> DataFrame:
    """Candidates that are open around an element number its depth among them; the last one opened at that depth is nearest.

    Each element asks, and each candidate stands, once for each step; what was found comes back to the element's own row."""
    keep, stands = rows.columns, sorted({s.before for s in steps})
    closing = F.when(_any(stands), F.struct(F.col("last_id").alias("at"), F.lit(1).alias("closes")))
    places = rows.select("*", F.inline(F.array_compact(F.array(F.struct(F.col("node_id").alias("at"), F.lit(0).alias("closes")), closing))))
    earlier = Window.partitionBy("doc_id").orderBy("at", "closes").rowsBetween(Window.unboundedPreceding, -1)
    moves = {b: F.sum(F.when(_flag(b), 1 - 2 * F.col("closes")).otherwise(0)).over(earlier) for b in stands}
    deep = places.select(*keep, "closes", *[F.coalesce(m, F.lit(0)).cast("int").alias(f"open{b}_") for b, m in moves.items()]).where("closes = 0")
    place = lambda i, level, asks: F.struct(F.lit(i).alias("step_"), level.alias("level_"), F.lit(asks).alias("asks_"))
    asking = [F.when(_flag(s.own), place(i, F.col(f"open{s.before}_"), 1)) for i, s in enumerate(steps)]
    standing = [F.when(_flag(s.before), place(i, F.col(f"open{s.before}_") + 1, 0)) for i, s in enumerate(steps)]
    asked = deep.select(*keep, F.inline(F.array_compact(F.array(place(-1, F.lit(0), 1), *asking, *standing))))
    before = Window.partitionBy("doc_id", "step_", "level_").orderBy("node_id", "asks_").rowsBetween(Window.unboundedPreceding, -1)
    ends = reduce(lambda c, i: c.when(F.col("step_") == i, _flag(steps[i].ends)), range(1, len(steps)), F.when(F.col("step_") == 0, _flag(steps[0].ends)))
    given = asked.withColumn("last_", F.last(F.when(F.col("asks_") == 0, ends), ignorenulls=True).over(before))
    own = Window.partitionBy("doc_id", "node_id")
    found = {s: F.max(F.when((F.col("step_") == i) & (F.col("asks_") == 1), F.col("last_"))).over(own) for i, s in enumerate(steps)}
    return _done(given, [*keep, "step_"], found).where("step_ = -1").drop("step_")


def _siblings(rows: DataFrame, steps: list[_Step], split: int | None) -> DataFrame:
    keep = rows.columns
    values = [F.when(_flag(s.before), _flag(s.ends)) if s.nearest else F.when(_flag(s.ends), True) for s in steps]

    def upto(family: list[str], end: int) -> list[Column]:
        w = Window.partitionBy(*family).orderBy("node_id").rowsBetween(Window.unboundedPreceding, end)
        return [F.last(v, ignorenulls=True).over(w) for v in values]

    if not split:
        return _done(rows, keep, dict(zip(steps, upto(["doc_id", "parent_id"], -1), strict=True)))
    # the sum of a range goes, as a row of its own, to the range that comes next among the family's
    names = [f"sum{i}_" for i in range(len(steps))]
    ranged = rows.withColumn("range_", F.floor(F.col("node_id") / split).cast("int"))
    family = ["doc_id", "parent_id", "range_"]
    following = F.lead("node_id").over(Window.partitionBy(*family).orderBy("node_id"))
    inner = ranged.select("*", *[x.alias(f"{n}in") for n, x in zip(names, upto(family, -1), strict=True)], *[x.alias(n) for n, x in zip(names, upto(family, 0), strict=True)], following.isNull().alias("last_"))
    doubled = inner.select("*", F.explode(F.when(F.col("last_"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("row_")).withColumn("part_", F.when(F.col("row_") == 0, F.lit(-1)).otherwise(F.col("range_")))
    sums = Window.partitionBy("doc_id", "parent_id", "part_").orderBy("range_", "node_id")
    running = sums.rowsBetween(Window.unboundedPreceding, 0)
    added = doubled.select("*", *[F.when(F.col("row_") == 0, F.last(n, ignorenulls=True).over(running)).alias(f"{n}upto") for n in names], F.when(F.col("row_") == 0, F.lead("range_").over(sums)).otherwise(F.col("range_")).alias("to_"))
    carried = Window.partitionBy("doc_id", "parent_id", "to_").orderBy("row_", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = {s: F.coalesce(F.col(f"{n}in"), F.first(F.col(f"{n}upto")).over(carried)) for n, s in zip(names, steps, strict=True)}
    return _done(added.where("to_ is not null"), [*keep, "row_"], whole).where("row_ = 1").drop("row_")


def _fetched(rows: DataFrame, steps: list[_Step], key: str) -> DataFrame:
    """Steps to the one element whose number is in a column."""
    keep = rows.columns
    given = F.when(_any([s.ends for s in steps]), F.struct(F.col("node_id").alias("key_"), F.lit(0).alias("asks_")))
    both = rows.select("*", F.inline(F.array_compact(F.array(F.struct(F.col(key).alias("key_"), F.lit(1).alias("asks_")), given))))
    w = Window.partitionBy("doc_id", "key_").orderBy("asks_").rowsBetween(Window.unboundedPreceding, 0)
    stands = (F.col("asks_") == 0) & F.col("key_").isNotNull()
    return _done(both, [*keep, "asks_"], {s: F.max(F.when(stands, _flag(s.ends))).over(w) for s in steps}).where("asks_ = 1").drop("asks_")


def _run(rows: DataFrame, steps: list[_Step], split: int | None) -> DataFrame:
    """Steps that don't depend on each other: those of a kind share a window."""
    plain = [s for s in steps if s.how == " " and not s.nearest]
    if plain:
        rows = _descendants(rows, plain)
    nearest = [s for s in steps if s.how == " " and s.nearest]
    if nearest:
        rows = _nearest_ancestors(rows, nearest)
    for how, key in ((">", "parent_id"), ("+", "prev_el")):
        some = [s for s in steps if s.how == how]
        if some:
            rows = _fetched(rows, some, key)
    beside = [s for s in steps if s.how == "~"]
    return _siblings(rows, beside, split) if beside else rows


class _Compiled:
    """Selectors compiled to predicates of compounds, what nested :not() ask for, and a trie of steps. Each compound and each
    step is a flag."""

    def __init__(self, semantics: str):
        self.semantics = semantics
        self.flags = 0
        #: compound -> flag, its predicate without nested selectors, and these.
        self.compounds: dict[sel.Compound, tuple[int, Column, list[tuple[sel.Chain, ...]]]] = {}
        #: steps by how deep they are nested in :not(), inner first, then by place in the chain.
        self.steps: dict[tuple[int, int], dict[tuple, _Step]] = {}
        #: nested selectors -> how deep they are nested, and the flags of their chains.
        self.nested: dict[tuple[sel.Chain, ...], tuple[int, list[int]]] = {}

    def _next(self) -> int:
        self.flags += 1
        return self.flags - 1

    def compound(self, c: sel.Compound) -> int:
        if c not in self.compounds:
            simple = [(s, _simple(s)) for s in c]
            inner = [sel.parse(s.value) for s, column in simple if column is None]
            self.compounds[c] = (self._next(), reduce(lambda a, b: a & b, [x for _, x in simple if x is not None], F.lit(True)), inner)
            for chains in inner:
                if chains not in self.nested:
                    self.nested[chains] = (0, [])
                    found = [self.chain(x) for x in chains]
                    self.nested[chains] = (1 + max(self.depth(x) for x in chains), found)
        return self.compounds[c][0]

    def depth(self, chain: sel.Chain) -> int:
        """How deep :not() with combinators are nested below a chain's compounds."""
        return max((self.nested[x][0] for _, c in chain for x in self.compounds[c][2]), default=0)

    def chain(self, chain: sel.Chain) -> int:
        """The flag that says which elements a chain matches."""
        own = [self.compound(c) for _, c in chain]
        compat, depth, ends = self.semantics == "compat" and nearest_matters(chain), self.depth(chain), own[0]
        for i in range(1, len(chain)):
            how = chain[i][0]
            level = self.steps.setdefault((depth, i), {})
            key = (how, compat and how in " ~", own[i - 1], ends, own[i])
            if key not in level:
                level[key] = _Step(*key, self._next())
            ends = level[key].out
        return ends

    def rows(self, nodes: DataFrame, split: int | None, whole: bool = False, partitions: int | None = None) -> DataFrame:
        """Elements that some compound matches, with flags; or whole rows of all nodes. With partitions, what is left is dealt out
        once, by document, into as many, if there is any step to make."""
        element = F.expr(ELEMENTS)
        rows = nodes if whole else nodes.where(element)
        compounds = [n for n, _, _ in self.compounds.values()]
        rows = _set(rows, {n: F.coalesce(element & p if whole else p, F.lit(False)) for n, p, _ in self.compounds.values()})
        flags = [f"flags{k}_" for k in range(-(-self.flags // BITS))]
        rows = rows.select(*(nodes.columns if whole else FIELDS), *[n if n in rows.columns else F.lit(0).cast("long").alias(n) for n in flags])
        if not whole:
            rows = rows.where(_any(compounds))
        if partitions and (self.steps or self.nested):
            rows = rows.repartition(partitions, "doc_id")
        deepest = max((d for d, _ in self.steps), default=0)
        for depth in range(max([deepest, *(d for d, _ in self.nested.values())]) + 1):
            for n, _, inner in self.compounds.values():
                if inner and max(self.nested[x][0] for x in inner) == depth:
                    rows = self._excluded(rows, n, [i for chains in inner for i in self.nested[chains][1]])
            for d, i in sorted(self.steps):
                if d == depth:
                    rows = _run(rows, list(self.steps[d, i].values()), split)
        return rows

    def _excluded(self, rows: DataFrame, flag: int, others: list[int]) -> DataFrame:
        """A flag taken back where any of others is set."""
        name = f"flags{flag // BITS}_"
        return rows.withColumn(name, F.when(_any(others), F.col(name).bitwiseAND(F.lit(~(1 << flag % BITS)))).otherwise(F.col(name)))


def _check(semantics: str) -> None:
    if semantics not in ("compat", "css"):
        raise ValueError("semantics must be compat or css")


ELEMENTS = "node_type = 1 and not in_template"


def select_nodes(nodes: DataFrame, selector: str, semantics: str = "compat", split: int | None = None, partitions: int | None = None) -> DataFrame:
    """(doc_id, node_id, parent_id, last_id, el_idx, prev_el) of the elements that match in a table of nodes.

    split: node numbers of a range of siblings, where a parent may have millions of children; by default a family is one.
    partitions: parts in which documents are dealt out, so that a part doesn't grow with the table (parse.shares() says how many);
    by default each step's shuffle is the session's."""
    _check(semantics)
    made = _Compiled(semantics)
    chains = [made.chain(c) for c in sel.parse(selector)]
    return made.rows(nodes, split, partitions=partitions).where(_any(chains)).select(*FIELDS)


def mark_nodes(nodes: DataFrame, selector: str, name: str = "matched", semantics: str = "compat", split: int | None = None) -> DataFrame:
    """All nodes with a boolean column that says which elements match."""
    _check(semantics)
    made = _Compiled(semantics)
    chains = [made.chain(c) for c in sel.parse(selector)]
    return made.rows(nodes, split, whole=True).select(*nodes.columns, _any(chains).alias(name))


def select_many(nodes: DataFrame, selectors: list[str], semantics: str = "compat", split: int | None = None, partitions: int | None = None) -> DataFrame:
    """(selector_idx, doc_id, node_id, parent_id, last_id, el_idx, prev_el): what each of many selectors matches, found together.

    selector_idx is the place in the list. A bad selector raises SelectorError here, on the driver."""
    _check(semantics)
    made = _Compiled(semantics)
    chains = [[made.chain(c) for c in sel.parse(s)] for s in selectors]
    if not chains:
        return nodes.where("false").select(F.lit(0).alias("selector_idx"), *FIELDS)
    met = F.array_compact(F.array(*[F.when(_any(some), F.lit(i)) for i, some in enumerate(chains)]))
    rows = made.rows(nodes, split, partitions=partitions).where(_any([i for some in chains for i in some]))
    return rows.select(F.explode(met).alias("selector_idx"), *FIELDS)
