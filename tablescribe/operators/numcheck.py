"""Numbers of a printed table held against the identities between its columns: verify, fill blanks, fix misreads.

A table is the rows of one key (`by`); its columns are roles (qty, unitTp, totalTp, ...). Everything but the choice of the
identities is row by row: the passes are column expressions, the choice is one aggregation per table and a join of its
one row back to the table's rows.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescribe.functions.amounts import plausible_misread, relation_tolerance
from tablescribe.functions.numbers import half_up
from tablescribe.sources.scratch import written

Values = Mapping[str, Column]
#: Roles that are whole numbers.
WHOLE = ("qty", "bonus")


@dataclass(frozen=True)
class Relation:
    """target = made(the other roles). Of the relations of one group a table follows one. Optional roles count as 0 where the
    table has no such column. Per unit: rounding adds up with the quantity."""

    name: str
    roles: tuple[str, ...]  # the target first
    made: Callable[[Values], Column]
    group: str = ""
    optional: tuple[str, ...] = ()
    per_unit: bool = False

    def solve(self, role: str, v: Values) -> Column:
        """The role's value from all others, null where it can't be told. The identities are linear in each role."""
        if role == self.roles[0]:
            return self.made(v)
        at = lambda x: self.made({**v, role: F.lit(float(x))})
        slope = at(1) - at(0)
        return F.when(F.abs(slope) > 1e-9, (v[self.roles[0]] - at(0)) / slope)


# The identities between the columns of an invoice.
RELATIONS = (
    Relation("gross", ("unitGross", "unitTp", "unitVat"), lambda v: v["unitTp"] + v["unitVat"]),
    Relation("uvat", ("unitVat", "unitTp", "vatPct"), lambda v: v["unitTp"] * v["vatPct"] / 100),
    Relation("ttp", ("totalTp", "qty", "unitTp"), lambda v: v["qty"] * v["unitTp"], per_unit=True),
    Relation("tvat", ("totalVat", "qty", "unitVat"), lambda v: v["qty"] * v["unitVat"], per_unit=True),
    Relation("tvatpct", ("totalVat", "totalTp", "vatPct"), lambda v: v["totalTp"] * v["vatPct"] / 100),
    Relation("spGross", ("unitSp", "unitTp", "unitVat"), lambda v: v["unitTp"] + v["unitVat"]),
    Relation("tsp", ("totalSp", "qty", "unitSp"), lambda v: v["qty"] * v["unitSp"], per_unit=True),
    Relation("udisc", ("discAmt", "qty", "unitDisc"), lambda v: v["qty"] * v["unitDisc"], per_unit=True),
    Relation("discA", ("discAmt", "totalTp", "discPct"), lambda v: v["totalTp"] * v["discPct"] / 100, group="disc"),
    Relation("discB", ("discAmt", "totalTp", "totalVat", "discPct"), lambda v: (v["totalTp"] + v["totalVat"]) * v["discPct"] / 100, group="disc"),
    Relation("net1", ("net", "totalTp", "totalVat", "discAmt"), lambda v: v["totalTp"] + v["totalVat"] - v["discAmt"], "net", ("discAmt",)),
    Relation("net2", ("net", "qty", "unitGross", "discAmt"), lambda v: v["qty"] * v["unitGross"] - v["discAmt"], "net", ("discAmt",), True),
    Relation("net3", ("net", "totalTp", "discAmt"), lambda v: v["totalTp"] - v["discAmt"], "net", ("discAmt",)),
    Relation("net4", ("net", "totalSp", "discAmt"), lambda v: v["totalSp"] - v["discAmt"], "net", ("discAmt",)),
    Relation("net5", ("net", "qty", "unitTp", "unitVat", "discAmt"), lambda v: v["qty"] * (v["unitTp"] + v["unitVat"]) - v["discAmt"], "net", ("discAmt",), True),
)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def _folded(tree: ast.expr, value: Callable[[str], Column | float]) -> Column | float:
    """The four operations, brackets, numbers and names of an expression, from the leaves up; ValueError for anything else."""
    if isinstance(tree, ast.BinOp) and type(tree.op) in _OPERATORS:
        return _OPERATORS[type(tree.op)](_folded(tree.left, value), _folded(tree.right, value))
    if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.USub):
        return -_folded(tree.operand, value)
    if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.UAdd):
        return _folded(tree.operand, value)
    if isinstance(tree, ast.Constant) and isinstance(tree.value, (int, float)):
        return tree.value
    if isinstance(tree, ast.Name):
        return value(tree.id)
    raise ValueError("only numbers, names and the four operations")


def formula_relation(key: str, formula: str, roles: Mapping[str, str]) -> Relation | None:
    """A relation that a user writes, '{qty}*{tp}' for the column key; null if a name is unknown or the formula holds
    anything but numbers, + - * /, brackets and names."""
    names = [n.strip() for n in re.findall(r"\{([^}]+)\}", formula)]
    body = re.sub(r"\{([^}]+)\}", lambda m: f"{{{m[1].strip()}}}", formula)
    if not names or key in names or key not in roles or any(n not in roles for n in names) or re.search(r"\*\s*\*|/\s*/", body) or not re.fullmatch(r"[\s0-9.+\-*/()]*", re.sub(r"\{[^}]+\}", "", body)):
        return None
    used = tuple(dict.fromkeys(roles[n] for n in names))
    places = {f"n{k}": roles[n] for k, n in enumerate(names)}
    numbered = iter(places)
    try:
        tree = ast.parse(re.sub(r"\{[^}]+\}", lambda m: f" {next(numbered)} ", body).strip(), mode="eval").body
    except SyntaxError:
        return None
    if not all(isinstance(n, (ast.BinOp, ast.UnaryOp, ast.Constant, ast.Name, ast.Load, ast.USub, ast.UAdd, *_OPERATORS)) for n in ast.walk(tree)):
        return None
    made = lambda v: _folded(tree, lambda name: v[places[name]])

    return Relation(f"rule:{key}", (roles[key], *used), made, group=f"target:{roles[key]}", per_unit="qty" in used and "*" in formula)


def applicable(present: Sequence[str], relations: Sequence[Relation] = RELATIONS) -> list[Relation]:
    return [r for r in relations if all(x in present or x in r.optional for x in r.roles) and r.roles[0] in present]


def _values(present: Sequence[str], r: Relation) -> dict[str, Column]:
    return {x: F.col(x) if x in present else F.lit(0.0) for x in r.roles}


def _holds(r: Relation, v: Values) -> Column:
    """Whether both sides agree; null where a value is missing."""
    made = r.solve(r.roles[0], v)
    return F.abs(made - v[r.roles[0]]) <= relation_tolerance(made, v.get("qty") if r.per_unit else None)


def relation_stats(rows: DataFrame, by: Sequence[str], present: Sequence[str], relations: Sequence[Relation] = RELATIONS) -> DataFrame:
    """(by, relation, tested, held, chosen): how many rows each relation could be tested on and held on, and whether the
    table follows it: on half the rows or more, and best of its group."""
    some = applicable(present, relations)
    counts = rows.groupBy(*by).agg(*[f for r in some for f in (F.count(_holds(r, _values(present, r))).alias(f"{r.name}.n"), F.count_if(_holds(r, _values(present, r))).alias(f"{r.name}.k"))])
    n, k = (lambda r: F.col(f"`{r.name}.n`")), (lambda r: F.col(f"`{r.name}.k`"))
    rate = lambda r: F.coalesce(F.try_divide(k(r), n(r)), F.lit(0.0))

    def chosen(i: int, r: Relation) -> Column:
        rivals = [(j, o) for j, o in enumerate(some) if r.group and o.group == r.group and o is not r]
        best = F.lit(True)
        for j, o in rivals:
            better = (rate(o) > rate(r)) | ((rate(o) == rate(r)) & (k(o) > k(r))) | ((rate(o) == rate(r)) & (k(o) == k(r)) & F.lit(j < i))
            best = best & ~better
        return best & ((n(r) == 0) | (rate(r) >= 0.5))

    stats = [F.struct(F.lit(r.name).alias("relation"), n(r).alias("tested"), k(r).alias("held"), chosen(i, r).alias("chosen")) for i, r in enumerate(some)]
    return counts.select(*by, F.explode(F.array(*stats)).alias("s")).select(*by, "s.*")


def _rounded(role: str, value: Column) -> Column:
    whole = half_up(value)
    return F.when(F.abs(value - whole) <= 0.05, whole) if role in WHOLE else half_up(value, 2)


def _agreed(ways: Column, whole: bool) -> Column:
    """The value that most of the ways give; null if there is none, or as many give another."""
    near = (lambda a, b: a == b) if whole else (lambda a, b: F.abs(a - b) <= F.greatest(F.lit(0.011), 0.005 * F.abs(a)))
    votes = F.transform(ways, lambda v, i: F.struct(F.size(F.filter(ways, lambda o: near(v, o))).alias("n"), (-i).alias("i"), v.alias("v")))
    top = F.array_max(votes)
    return F.when(F.forall(votes, lambda s: (s["n"] < top["n"]) | near(s["v"], top["v"])), top["v"])


def repair(rows: DataFrame, by: Sequence[str], present: Sequence[str], relations: Sequence[Relation] = RELATIONS, texts: Mapping[str, str] | None = None, passes: int = 2) -> DataFrame:
    """rows with the roles repaired, and: filled and fixed (names of roles), failed (relations that still don't hold).

    Fill: a missing value that the table's relations give from the others; where they disagree the value that most give,
    and none on a tie. Fix: where a relation fails, the one value whose change makes more relations hold and breaks
    none, if the printed text (texts: role -> column) may be it misread or two relations agree. One value of a row is fixed.
    """
    some = applicable(present, relations)
    stats = relation_stats(rows, by, present, relations)
    used = stats.groupBy(*by).agg(F.collect_set(F.when(F.col("chosen"), F.col("relation"))).alias("__used"))
    df = rows.join(used, list(by)).withColumns({"filled": F.array().cast("array<string>"), "fixed": F.array().cast("array<string>")})
    on = lambda r: F.array_contains("__used", r.name)
    for _ in range(passes):
        ways = {x: [F.when(on(r) & F.col(x).isNull(), _rounded(x, r.solve(x, _values(present, r)))) for r in some if x in r.roles] for x in present}
        ways = {x: w for x, w in ways.items() if w}
        df = df.withColumns({f"__w_{x}": F.filter(F.array_compact(F.array(*w)), lambda v: v >= 0) for x, w in ways.items()})
        df = written(df.withColumns({f"__v_{x}": _agreed(F.col(f"__w_{x}"), x in WHOLE) for x in ways}).drop(*[f"__w_{x}" for x in ways]), "voted")
        done = F.array_compact(F.array(*[F.when(F.col(f"__v_{x}").isNotNull(), F.lit(x)) for x in ways]))
        df = df.withColumns({"filled": F.concat("filled", done), **{x: F.coalesce(F.col(x), F.col(f"__v_{x}")) for x in ways}}).drop(*[f"__v_{x}" for x in ways])
    tested = df.withColumns({f"__ok_{r.name}": F.when(on(r), _holds(r, _values(present, r))) for r in some})
    df = written(tested.withColumn("__id", F.monotonically_increasing_id()), "tested")
    # only rows on which a relation fails have candidates: each a row of its own, so that its tests are written once
    candidates = [F.when(~F.col(f"__ok_{r.name}"), F.struct(F.lit(i).alias("i"), F.lit(x).alias("role"), _rounded(x, r.solve(x, _values(present, r))).alias("value"))) for i, (r, x) in enumerate((r, x) for r in some for x in r.roles if x in present)]
    asked = df.where(F.least(*[F.coalesce(F.col(f"__ok_{r.name}"), F.lit(True)) for r in some], F.lit(True)) == F.lit(False)) if some else df.where("false")
    each = asked.withColumn("__c", F.explode(F.array_compact(F.array(*candidates)))).where("__c.value >= 0")
    changed = {x: F.when(F.col("__c.role") == x, F.col("__c.value")).otherwise(F.col(x)) for x in present}
    after = {r.name: F.when(on(r), _holds(r, {**_values(present, r), **{x: changed[x] for x in r.roles if x in present}})) for r in some}
    count = lambda conditions: sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))
    each = each.withColumns({"__gain": count([after[r.name] & ~F.col(f"__ok_{r.name}") for r in some]), "__loss": count([~after[r.name] & F.col(f"__ok_{r.name}") for r in some])}).where("__gain > 0 and __loss = 0")
    printed = F.coalesce(*[F.when(F.col("__c.role") == x, F.col(texts[x]) if texts and x in texts else F.format_string("%.2f", F.col(x))) for x in present])
    likely = F.coalesce(plausible_misread(F.col("__c.value"), printed), F.lit(False)) | (F.col("__gain") >= 2)
    best = each.where(likely).groupBy("__id").agg(F.max(F.struct("__gain", (-F.col("__c.i")).alias("first"), F.col("__c.role").alias("role"), F.col("__c.value").alias("value"))).alias("__fix"))
    df = df.join(best, "__id", "left")
    roles = {x: F.when(F.col("__fix.role") == x, F.col("__fix.value")).otherwise(F.col(x)) for x in present}
    df = df.withColumns({"fixed": F.array_compact(F.array(F.col("__fix.role"))), **roles})
    failed = F.array_compact(F.array(*[F.when(on(r) & ~_holds(r, _values(present, r)), F.lit(r.name)) for r in some]))
    return df.withColumn("failed", failed).select(*rows.columns, "filled", "fixed", "failed")
