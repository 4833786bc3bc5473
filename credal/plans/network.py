"""Bayesian networks: order, signatures, and the exact program of a posterior as column expressions."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Network:
    """Vertices in order of declaration, edges (source, target), and groups (vertex to group name)."""

    id: str
    vertices: list[str]
    edges: list[tuple[str, str]]
    groups: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def read(text: str) -> "Network":
        """From JSON with vertices (ids, or objects with id and group) and edges (objects with source and target)."""
        raw = json.loads(text)
        named = [v if isinstance(v, dict) else {"id": v} for v in raw["vertices"]]
        return Network(raw.get("id", ""), [v["id"] for v in named], [(e["source"], e["target"]) for e in raw["edges"]], {v["id"]: v["group"] for v in named if v.get("group")})

    def parents(self, v: str) -> list[str]:
        return [s for s, t in self.edges if t == v]

    def inputs(self) -> list[str]:
        return [v for v in self.vertices if not self.parents(v)]

    def outputs(self) -> list[str]:
        return [v for v in self.vertices if not any(s == v for s, _ in self.edges)]

    def ordered(self) -> list[str]:
        """Topological order, ties by declaration; a loop is an error."""
        out: list[str] = []
        while len(out) < len(self.vertices):
            free = [v for v in self.vertices if v not in out and all(p in out for p in self.parents(v))]
            if not free:
                raise ValueError("the network has a loop")
            out.append(free[0])
        return out

    def group_order(self) -> list[str]:
        return list(dict.fromkeys(self.groups[v] for v in self.ordered() if v in self.groups))

    def signatures(self) -> list[str]:
        """Every presence pattern of the groups, present first."""
        return ["".join(x) for x in itertools.product("TF", repeat=len(self.group_order()))]

    def erase(self, absent: set[str]) -> "Network":
        """Without the absent groups' vertices; edges go on to the nearest descendants that stay."""
        gone = {v for v in self.vertices if self.groups.get(v) in absent}

        def below(v: str) -> list[str]:
            return [w for t in (t for s, t in self.edges if s == v) for w in (below(t) if t in gone else [t])]

        kept = [v for v in self.vertices if v not in gone]
        return Network(self.id, kept, list(dict.fromkeys((v, w) for v in kept for w in below(v))), {v: g for v, g in self.groups.items() if v in kept})

    def parameter_names(self) -> list[str]:
        """Each vertex with parents, given each pattern of them, true first: inf_x_t$tf."""
        out = []
        for v in self.ordered():
            n = len(self.parents(v))
            out += [f"prior_{v}"] if not n else [f"inf_{v}_t${''.join(s)}" for s in itertools.product("tf", repeat=n)]
        return out

    def posterior(self, hypothesis: str, evidence: dict[str, Column | bool | None], parameter: dict[str, Column | float]) -> dict[str, Column]:
        """prior, evidence and posterior of a hypothesis, summed over the vertices that evidence leaves open.

        evidence: true, false or null (open), by vertex; an expression that is null for a row leaves the vertex open there.
        """
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        seen = {v: as_column(evidence.get(v)) for v in self.vertices}
        order = self.ordered()

        def joint(signs: dict[str, bool]) -> Column:
            out = F.lit(1.0)
            for v in order:
                above = self.parents(v)
                name = f"inf_{v}_t${''.join('t' if signs[p] else 'f' for p in above)}" if above else f"prior_{v}"
                p = as_column(parameter[name])
                e = seen[v].cast("boolean")
                allowed = F.when(e.isNull() | (e == F.lit(signs[v])), 1.0).otherwise(0.0)
                out = out * (p if signs[v] else 1 - p) * allowed
            return out

        cases = [dict(zip(order, s)) for s in itertools.product((True, False), repeat=len(order))]
        total = sum((joint(c) for c in cases), F.lit(0.0))
        true = sum((joint(c) for c in cases if c[hypothesis]), F.lit(0.0))
        return {"evidence": total, "posterior": F.when(total < 1e-9, 0.0).otherwise(true / total)}

    def below(self, v: str) -> list[str]:
        """All vertices that edges lead to from a vertex, in order."""
        found: set[str] = set()
        todo = [v]
        while todo:
            for s, t in self.edges:
                if s == todo[0] and t not in found:
                    found.add(t)
                    todo.append(t)
            todo.pop(0)
        return [x for x in self.ordered() if x in found]

    def horizon(self, v: str) -> tuple[list[str], list[str]]:
        """(horizon, interior) of a vertex: its targets, nearest level first, where those that share what follows with the rest of the queue
        are interior and passed through; the others are the horizon."""
        level: dict[str, int] = {}
        for x in self.ordered():
            level[x] = max((level[p] + 1 for p in self.parents(x)), default=0)
        reach = {x: {x, *self.below(x)} for x in self.vertices}
        queue = {t for s, t in self.edges if s == v}
        edge, inner = [], []
        while queue:
            x = min(queue, key=lambda q: (level[q], q))
            queue.remove(x)
            if any((reach[x] - {x}) & reach[o] for o in queue):
                inner.append(x)
                queue |= {t for s, t in self.edges if s == x}
            else:
                edge.append(x)
        return edge, inner

    def sources(self) -> set[str]:
        """Vertices whose probability is computed: those on a horizon, and outputs. Others count by evidence alone."""
        return {x for v in self.vertices for x in self.horizon(v)[0]} | set(self.outputs())

    def derivation_order(self, needs: dict[str, list[str]]) -> list[str]:
        """Vertices with derivations after those that they derive from, ties by declaration; a loop is an error."""
        return Network(self.id, [v for v in self.vertices if v in needs], [(s, v) for v, xs in needs.items() for s in xs if s in needs]).ordered()

    def json(self) -> str:
        """The text that ``read`` reads."""
        return json.dumps({"id": self.id, "vertices": [{"id": v} | ({"group": self.groups[v]} if v in self.groups else {}) for v in self.vertices], "edges": [{"source": s, "target": t} for s, t in self.edges]})

    def dot(self, full: bool = False) -> str:
        """The network in the DOT language; ``full`` adds groups as clusters and marks hypotheses and outputs."""
        lines = [f'digraph "{self.id}" {{']
        for v in self.vertices:
            marks = " [shape=box]" if full and v in self.inputs() else " [shape=doublecircle]" if full and v in self.outputs() else ""
            lines.append(f'  "{v}"{marks};')
        if full:
            for g in self.group_order():
                inside = " ".join(f'"{v}";' for v in self.vertices if self.groups.get(v) == g)
                lines.append(f'  subgraph "cluster_{g}" {{ label="{g}"; {inside} }}')
        return "\n".join([*lines, *[f'  "{s}" -> "{t}";' for s, t in self.edges], "}"])

    def by_signature(self, signature: Column, hypothesis: str, evidence: dict[str, Column], parameter: dict[str, dict[str, Column]], present: list[str]) -> dict[str, Column]:
        """evidence and posterior of each row by the program of its signature's sub-network; a signature not in ``present`` is an error in the row.

        parameter: by signature, the parameters of that sub-network. Only signatures that the data hold need be given.
        """
        order = self.group_order()
        out: dict[str, Column] = {}
        for part in ("evidence", "posterior"):
            chosen = F.raise_error(F.concat(F.lit("unknown signature "), F.coalesce(signature, F.lit("null")))).cast("double")
            for s in present:
                sub = self.erase({g for g, bit in zip(order, s) if bit == "F"})
                chosen = F.when(signature == s, sub.posterior(hypothesis, {v: e for v, e in evidence.items() if v in sub.vertices}, parameter[s])[part]).otherwise(chosen)
            out[part] = chosen
        return out

    def program(self, df: DataFrame, hypothesis: str, evidence: dict[str, Column], parameter: dict[str, Column], prior: Column) -> DataFrame:
        """Adds evidence, conditional and posterior of a hypothesis to each row.

        For either sign of the hypothesis, each source vertex in order has a weight for true and one for false: the sum over the signs of
        the vertices between it and the sources above, of its probability, theirs, and the weights above. Vertices that are no source
        count by evidence alone: null evidence allows both signs. The outputs' weights multiply to the probability of the evidence.
        Cost is exponential in what lies between two sources, not in the network.
        """
        sources = (self.sources() | {hypothesis}) & set(self.vertices)
        seen = {v: evidence.get(v, F.lit(None)).cast("boolean") for v in self.vertices}
        allowed = lambda v, sign: F.when(seen[v].isNull() | (seen[v] == F.lit(sign)), 1.0).otherwise(0.0)
        order = [v for v in self.ordered() if v in sources and v != hypothesis]
        col = lambda h, v, sign: F.col(f"_{'t' if h else 'f'}_{v}_{'t' if sign else 'f'}")

        def p(v: str, signs: dict[str, bool]) -> Column:
            above = self.parents(v)
            name = f"inf_{v}_t${''.join('t' if signs[x] else 'f' for x in above)}" if above else f"prior_{v}"
            return parameter[name] if signs[v] else 1 - parameter[name]

        def weight(h: bool, v: str, sign: bool) -> Column:
            between, above, todo = [], [], list(self.parents(v))
            while todo:
                x = todo.pop(0)
                if x in sources:
                    above += [x] if x not in above else []
                elif x not in between:
                    between.append(x)
                    todo += self.parents(x)
            free = between + [x for x in above if x != hypothesis]
            total = F.lit(0.0)
            for signs in itertools.product((True, False), repeat=len(free)):
                at = dict(zip(free, signs)) | {hypothesis: h, v: sign}
                term = p(v, at)
                for x in between:
                    term = term * p(x, at) * allowed(x, at[x])
                for x in above:
                    term = term * col(h, x, at[x]) if x != hypothesis else term
                total = total + term
            return total * allowed(v, sign)

        out = df
        for v in order:
            out = out.withColumns({f"_{'t' if h else 'f'}_{v}_{'t' if s else 'f'}": weight(h, v, s) for h in (True, False) for s in (True, False)})
        made = [f"_{h}_{v}_{s}" for v in order for h in "tf" for s in "tf"]
        result = {h: allowed(hypothesis, h) for h in (True, False)}
        for v in self.outputs():
            if v != hypothesis:
                result = {h: r * (col(h, v, True) + col(h, v, False)) for h, r in result.items()}
        out = out.withColumns({"_prior": prior, "_ph": result[True] * prior, "_pn": result[False] * (1 - prior)}).withColumn("evidence", F.col("_ph") + F.col("_pn"))
        conditional = F.when(F.col("_prior") < 1e-9, 0.0).otherwise(F.col("_ph") / F.col("_prior"))
        return out.withColumns({"conditional": conditional, "posterior": F.when(F.col("evidence") < 1e-9, 0.0).otherwise(F.col("_ph") / F.col("evidence"))}).drop("_prior", "_ph", "_pn", *made)
