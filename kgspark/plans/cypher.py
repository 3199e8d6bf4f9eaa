"""A read-only subset of Cypher as DataFrame plans.

MATCH patterns over nodes (var:Label {key: value}) and relations -[var:A|B*1..2]->, <-[]-, -[]-; WHERE;
OPTIONAL MATCH of one hop; UNWIND; WITH; CALL of a procedure or of a subquery { WITH .. RETURN .. LIMIT } for
each row; RETURN [DISTINCT] with aggregates; ORDER BY, SKIP, LIMIT; UNION [ALL]; CASE; slices.
Patterns that share no variable need a condition that joins them.
Every pattern becomes joins of ``entities`` and ``edges``, a relation not being used twice in a path;
Catalyst orders them. What is not understood is refused with a message.

Properties of a node: name, type, and the columns of ``entities``; of a relation: the columns of ``edges``.
With chunks and mentions there are Chunk nodes (name is the chunk's id) and MENTIONED_IN relations too.
Functions: count, collect, sum, avg, min, max, size, toLower, toUpper, type, labels, coalesce, id, startNode, endNode, properties,
vec.cosineDistance, vecf32. Procedures: db.relationshipTypes, db.labels, db.idx.fulltext.queryNodes, db.idx.vector.queryNodes,
db.idx.vector.queryRelationships; scores fall, a vector's being its cosine and a text's the number of words found.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import tokens
from kgspark.functions.vector import cosine, top_k

# Words of statements that change something.
WRITING = re.compile(r"\b(create|merge|delete|set|remove|drop|detach|load|foreach)\b", re.I)
_TOKEN = re.compile(r"""\s+|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+|\d+)|(?P<op><>|<=|>=|=~|\.\.|->|<-|[-+*/%=<>()\[\]{},.:|])|(?P<param>\$\w+)|(?P<name>`[^`]+`|\w+)""")
CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "ORDER", "SKIP", "LIMIT", "UNION", "UNWIND", "CALL"}
AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
CHUNK, EVERY = "Chunk", ("Entity", "Concept")


class Unsupported(ValueError):
    """A statement outside the subset."""


def is_read_only(text: str) -> bool:
    return not WRITING.search(re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text))


@dataclass
class _State:
    df: DataFrame | None = None
    nodes: set = field(default_factory=set)
    rels: set = field(default_factory=set)
    values: dict = field(default_factory=dict)
    hops: list = field(default_factory=list)


class Compiler:
    def __init__(self, entities: DataFrame, edges: DataFrame, params: dict | None = None, chunks: DataFrame | None = None, mentions: DataFrame | None = None):
        self.params, self.n, self.aggregated = params or {}, 0, False
        self.has_chunks = chunks is not None
        if chunks is not None:
            own = chunks.select(F.col("chunk_id").alias("name"), F.lit(CHUNK).alias("type"), F.col("chunk_id").alias("id"), *[c for c in ("text", "doc_id", "embedding") if c in chunks.columns])
            entities = entities.unionByName(own, allowMissingColumns=True)
        if mentions is not None:
            edges = edges.unionByName(mentions.select(F.col("name").alias("src"), F.lit("MENTIONED_IN").alias("rel"), F.col("chunk_id").alias("dst")), allowMissingColumns=True)
        self.entities = entities.withColumn("_key", F.col("name"))
        self.edges = edges.withColumn("edge_id", F.xxhash64("src", "rel", "dst"))

    def run(self, text: str) -> DataFrame:
        if not is_read_only(text):
            raise Unsupported("only statements that read are accepted")
        self._tokens(text)
        out = self._query()
        while self._word("UNION"):
            keep = self._word("ALL")
            out = out.union(self._query())
            out = out if keep else out.distinct()
        if self.i < len(self.toks):
            raise Unsupported(f"unexpected: {self.toks[self.i][1]}")
        return out

    def _tokens(self, text: str) -> None:
        self.toks, self.i = [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(f"unexpected sign at: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.toks.append((m.lastgroup, m.group()))

    # tokens
    def _peek(self, k: int = 0) -> str:
        return self.toks[self.i + k][1] if self.i + k < len(self.toks) else ""

    def _word(self, w: str) -> bool:
        if self._peek().upper() == w and self.toks[self.i][0] == "name":
            self.i += 1
            return True
        return False

    def _op(self, o: str) -> bool:
        if self._peek() == o and self.toks[self.i][0] == "op":
            self.i += 1
            return True
        return False

    def _need(self, o: str) -> None:
        if not self._op(o):
            raise Unsupported(f"expected {o} before {self._peek() or 'the end'}")

    def _name(self) -> str:
        if self.i >= len(self.toks) or self.toks[self.i][0] != "name":
            raise Unsupported(f"expected a name before {self._peek() or 'the end'}")
        self.i += 1
        return self.toks[self.i - 1][1].strip("`")

    # clauses
    def _query(self) -> DataFrame:
        st = _State()
        while self.i < len(self.toks):
            if self._word("OPTIONAL"):
                if not self._word("MATCH"):
                    raise Unsupported("OPTIONAL without MATCH")
                self._match(st, optional=True)
            elif self._word("MATCH"):
                self._match(st, optional=False)
            elif self._word("UNWIND"):
                values = self._expr(st)
                if not self._word("AS"):
                    raise Unsupported("UNWIND without AS")
                name = self._name()
                base = st.df if st.df is not None else self._one()
                st.df, st.values[name] = base.withColumn(name, F.explode(values)), name
            elif self._word("WITH"):
                self._project(st, final=False)
            elif self._word("CALL"):
                self._subquery(st) if self._op("{") else self._procedure(st)
            elif self._word("RETURN"):
                return self._project(st, final=True)
            else:
                raise Unsupported(f"unsupported clause: {self._peek()}")
        raise Unsupported("a statement needs RETURN")

    def _one(self) -> DataFrame:
        return self.entities.sparkSession.range(1).select(F.lit(1).alias("_one"))

    def _procedure(self, st: _State) -> None:
        """CALL name(...) YIELD columns: the rows of a procedure, as the first clause of a statement."""
        if st.df is not None:
            raise Unsupported("CALL of a procedure must come first")
        name = [self._name()]
        while self._op("."):
            name.append(self._name())
        name, args = ".".join(name).lower(), []
        self._need("(")
        while not self._op(")"):
            args.append(self._literal())
            self._op(",")
        node = lambda df: df.select(F.struct(*[c for c in self.entities.columns if c != "_key"]).alias("node"), "score")
        if name in ("db.relationshiptypes", "db.labels"):
            col, out = ("rel", "relationshipType") if name.endswith("types") else ("type", "label")
            found = (self.edges if col == "rel" else self.entities).select(F.col(col).alias(out)).where(f"{out} is not null").distinct()
        elif name == "db.idx.fulltext.querynodes":
            words = F.array_distinct(tokens(F.lit(str(args[1]))))
            text = F.coalesce("text", "name") if "text" in self.entities.columns else F.col("name")
            found = node(self._labelled(args[0]).withColumn("score", F.size(F.array_intersect(tokens(text), words)).cast("double")).where("score > 0"))
        elif name == "db.idx.vector.querynodes":
            found = node(top_k(self._labelled(args[0]), args[1], list(args[3]), int(args[2]), "name"))
        elif name == "db.idx.vector.queryrelationships":
            e = self.edges.where(F.col("rel") == args[0]).withColumn("_id", F.col("edge_id"))
            found = top_k(e, args[1], list(args[3]), int(args[2]), "_id").select(F.struct(*self.edges.columns).alias("relationship"), "score")
        else:
            raise Unsupported(f"unknown procedure {name}")
        if self._word("YIELD"):
            while True:
                c = self._name()
                if c not in found.columns:
                    raise Unsupported(f"{name} gives no {c}")
                to = self._name() if self._word("AS") else c
                found = found.withColumnRenamed(c, to)
                if c == "node":
                    st.nodes.add(to)
                elif c == "relationship":
                    st.rels.add(to)
                else:
                    st.values[to] = to
                if not self._op(","):
                    break
        st.df = found
        self._where(st)

    def _labelled(self, label: str) -> DataFrame:
        if label in EVERY:
            return self.entities.where(F.col("type") != CHUNK) if self.has_chunks else self.entities
        return self.entities.where(F.col("type") == label)

    def _literal(self):
        """A number, string, list or parameter, as a value."""
        kind, t = self.toks[self.i]
        self.i += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if kind == "num":
            return float(t) if "." in t else int(t)
        if kind == "param":
            if t[1:] not in self.params:
                raise Unsupported(f"no parameter {t}")
            return self.params[t[1:]]
        if t == "-":
            return -self._literal()
        if t == "[":
            out = []
            while not self._op("]"):
                out.append(self._literal())
                self._op(",")
            return out
        if kind == "name" and t.lower() == "vecf32":
            self._need("(")
            out = self._literal()
            self._need(")")
            return out
        raise Unsupported(f"expected a value before {t}")

    def _subquery(self, st: _State) -> None:
        """CALL { WITH x, .. MATCH .. RETURN .. [ORDER BY ..] [LIMIT n] }: for each row; the limit counts within a row."""
        if not self._word("WITH") or st.df is None:
            raise Unsupported("a subquery must begin with WITH")
        names = [self._name()]
        while self._op(","):
            names.append(self._name())
        unknown = [n for n in names if n not in st.nodes | st.rels and n not in st.values]
        if unknown:
            raise Unsupported(f"unknown variable {unknown[0]}")
        key = {n: F.col(f"{n}.name") if n in st.nodes else F.col(f"{n}.edge_id") if n in st.rels else F.col(n) for n in names}
        keys = [f"_key_{n}" for n in names]
        outer = st.df.withColumns({f"_key_{n}": c for n, c in key.items()})
        inner = _State(outer.select(*names, *keys).dropDuplicates(keys), {n for n in names if n in st.nodes}, {n for n in names if n in st.rels}, {n: n for n in names if n in st.values})
        while not self._word("RETURN"):
            if self._word("OPTIONAL"):
                self._word("MATCH")
                self._match(inner, optional=True)
            elif self._word("MATCH"):
                self._match(inner, optional=False)
            else:
                raise Unsupported(f"unsupported in a subquery: {self._peek() or 'the end'}")
        items = []
        while True:
            start, self.aggregated = self.i, False
            c = self._expr(inner)
            raw = "".join(t for _, t in self.toks[start : self.i])
            items.append((self._name() if self._word("AS") else raw, c, self.aggregated, raw))
            if not self._op(","):
                break
        if any(a for *_, a, _ in items):
            found = inner.df.groupBy(*keys, *[c.alias(t) for t, c, a, _ in items if not a]).agg(*[c.alias(t) for t, c, a, _ in items if a])
        else:
            found = inner.df.select(*keys, *[c.alias(t) for t, c, *_ in items])
        cols, after = [], _State(found, {t for t, *_, r in items if r in inner.nodes}, {t for t, *_, r in items if r in inner.rels}, {t: t for t, *_ in items})
        if self._word("ORDER"):
            self._word("BY")
            while True:
                c = self._expr(after)
                cols.append(c.desc() if self._word("DESC") else c.asc())
                self._word("ASC")
                if not self._op(","):
                    break
        if self._word("LIMIT"):
            most, self.i = int(self._peek()), self.i + 1
            plain = [F.col(f"`{t}`") for t, *_ in items if t not in after.nodes | after.rels]
            w = Window.partitionBy(*keys).orderBy(*(cols or []), *(plain or [F.lit(1)]))
            found = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")
        self._need("}")
        st.df = outer.join(found, keys).drop(*keys)
        st.nodes |= after.nodes
        st.rels |= after.rels
        st.values |= {t: t for t, *_ in items if t not in after.nodes | after.rels}

    def _fresh(self, kind: str) -> str:
        self.n += 1
        return f"_{kind}{self.n}"

    def _node(self, st: _State) -> tuple[str, list, dict]:
        self._need("(")
        var = self._name() if self.toks[self.i][0] == "name" else self._fresh("n")
        labels, props = [], {}
        while self._op(":"):
            labels.append(self._name())
        if self._op("{"):
            while not self._op("}"):
                k = self._name()
                self._need(":")
                props[k] = self._expr(st)
                self._op(",")
        self._need(")")
        return var, labels, props

    def _bind(self, st: _State, var: str, labels: list, props: dict, df: DataFrame | None, key: str | None) -> DataFrame:
        """``df`` joined with the node's row by its key column; a bound node is only compared."""
        if var in st.nodes:
            if df is None:
                return st.df
            return df if key is None else df.where(F.col(key) == F.col(f"{var}.name"))
        e = self.entities.select(F.struct(*[c for c in self.entities.columns if c != "_key"]).alias(var), F.col("_key").alias(f"_k_{var}"))
        if self.has_chunks:
            e = e.where(F.col(f"{var}.type") != CHUNK) if set(labels) & set(EVERY) else e
        cond = [F.col(f"{var}.type") == x for x in labels if x not in EVERY] + [F.col(f"{var}.{k}") == v for k, v in props.items()]
        # conditions that speak of other variables wait for the join
        if df is not None and not key and not st.nodes | st.rels:
            # rows of an UNWIND only: a list of the statement, so every node meets each of its items
            out = e.crossJoin(F.broadcast(df))
            for c in cond:
                out = out.where(c)
            st.nodes.add(var)
            return out.drop(f"_k_{var}")
        if df is not None and not key:
            key = self._joined_by(st, var, props)
        out = e if df is None else df.join(e, key == F.col(f"_k_{var}")) if isinstance(key, Column) else df.join(e, F.col(key) == F.col(f"_k_{var}"))
        for c in cond:
            out = out.where(c)
        st.nodes.add(var)
        return out.drop(f"_k_{var}")

    def _joined_by(self, st: _State, var: str, props: dict) -> Column:
        """What ``var``'s name equals: its name in the pattern, or in a condition var.name = ... of the WHERE that follows. Without one the pattern would pair everything."""
        if "name" in props:
            return props["name"]
        at, depth = self.i, 0
        while at < len(self.toks) and self.toks[at][1].upper() != "WHERE" and not (depth == 0 and self.toks[at][1].upper() in CLAUSES - {"WHERE"}):
            at += 1
        k = at
        while k + 4 < len(self.toks) and self.toks[k][1].upper() not in CLAUSES - {"WHERE"}:
            t = [x[1] for x in self.toks[k : k + 8]]
            joined = t[0].upper() in ("WHERE", "AND") and t[4] == "=" and t[1:4] == [var, ".", "name"]
            turned = t[0].upper() in ("WHERE", "AND") and len(t) > 7 and t[4] == "=" and t[5:8] == [var, ".", "name"] and t[1] in st.nodes and t[2] == "."
            if (joined or turned) and not any(x[1].upper() == "OR" for x in self.toks[at:]):
                keep, self.i = self.i, k + (5 if joined else 1)
                try:
                    return self._atom(st)
                finally:
                    self.i = keep
            k += 1
        raise Unsupported(f"nothing joins {var} with what comes before; give its name or a condition {var}.name = ...")

    def _rel(self) -> tuple[str, list, int, int, str]:
        back = self._op("<-")
        if not back:
            self._need("-")
        var, types, lo, hi = self._fresh("r"), [], 1, 1
        if self._op("["):
            if self._peek() not in (":", "*", "]"):
                var = self._name()
            if self._op(":"):
                types.append(self._name())
                while self._op("|"):
                    self._op(":")
                    types.append(self._name())
            if self._op("*"):
                lo, hi = 1, 2
                if self.toks[self.i][0] == "num":
                    lo = hi = int(self._peek())
                    self.i += 1
                if self._op(".."):
                    if self.toks[self.i][0] != "num":
                        raise Unsupported("a path needs a greatest length")
                    hi = int(self._peek())
                    self.i += 1
            self._need("]")
        forth = self._op("->")
        if not forth:
            self._need("-")
        return var, types, lo, hi, "in" if back else "out" if forth else "both"

    def _hop(self, types: list, direction: str) -> DataFrame:
        e = self.edges if not types else self.edges.where(F.col("rel").isin(*types))
        row = F.struct(*e.columns).alias("_row")
        out = e.select(F.col("src").alias("_ha"), F.col("dst").alias("_hb"), row)
        if direction == "in":
            out = e.select(F.col("dst").alias("_ha"), F.col("src").alias("_hb"), row)
        if direction == "both":
            out = out.unionByName(e.where("src != dst").select(F.col("dst").alias("_ha"), F.col("src").alias("_hb"), row))
        return out

    def _match(self, st: _State, optional: bool) -> None:
        used: list[str] = []
        while True:
            if self._peek(1) == "=" and self._peek(2) == "(":
                raise Unsupported("named paths are not supported")
            var, labels, props = self._node(st)
            if optional and (st.df is None or var not in st.nodes):
                raise Unsupported("OPTIONAL MATCH must start at a bound node")
            df = self._bind(st, var, labels, props, st.df, None)
            at = f"{var}.name"
            while self._peek() in ("-", "<-"):
                rel, types, lo, hi, direction = self._rel()
                nvar, nlabels, nprops = self._node(st)
                if optional:
                    self._optional(st, df, at, rel, types, direction, nvar, nlabels, nprops)
                    if self._peek() in ("-", "<-"):
                        raise Unsupported("OPTIONAL MATCH takes one hop")
                    self._where(st)
                    return
                if lo == hi == 1:
                    hop, end = self._hop(types, direction), self._fresh("b")
                    hop = hop.select(F.col("_ha").alias(f"_a_{rel}"), F.col("_hb").alias(end), F.col("_row").alias(rel))
                    df = df.withColumn("_at", F.col(at)).join(hop, F.col("_at") == F.col(f"_a_{rel}")).drop("_at", f"_a_{rel}")
                    for u in used:
                        df = df.where(F.col(f"{u}.edge_id") != F.col(f"{rel}.edge_id"))
                    used.append(rel)
                    st.rels.add(rel)
                else:
                    df, end = self._var_length(df, at, types, direction, lo, hi, rel, st)
                df = self._bind(st, nvar, nlabels, nprops, df, end).drop(end)
                at = f"{nvar}.name"
            st.df = df
            if not self._op(","):
                break
        self._where(st)

    def _var_length(self, df: DataFrame, at: str, types: list, direction: str, lo: int, hi: int, rel: str, st: _State) -> tuple[DataFrame, str]:
        hop, end = self._hop(types, direction), self._fresh("b")
        now = df.withColumn(end, F.col(at)).withColumn(rel, F.array().cast("array<bigint>"))
        parts = []
        for k in range(1, hi + 1):
            step = hop.select(F.col("_ha").alias("_a"), F.col("_hb").alias("_b"), F.col("_row.edge_id").alias("_id"))
            now = now.join(step, F.col(end) == F.col("_a")).where(~F.array_contains(rel, F.col("_id")))
            now = now.withColumn(rel, F.array_append(rel, F.col("_id"))).withColumn(end, F.col("_b")).drop("_a", "_b", "_id")
            if k >= lo:
                parts.append(now)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        st.values[rel] = rel
        return out, end

    def _optional(self, st: _State, df: DataFrame, at: str, rel: str, types: list, direction: str, var: str, labels: list, props: dict) -> None:
        if var in st.nodes:
            raise Unsupported("OPTIONAL MATCH must end at a new node")
        hop = self._hop(types, direction)
        e = self.entities.select(F.struct(*[c for c in self.entities.columns if c != "_key"]).alias(var), F.col("_key"))
        for x in labels:
            if x not in EVERY:
                e = e.where(F.col(f"{var}.type") == x)
        for k, v in props.items():
            e = e.where(F.col(f"{var}.{k}") == v)
        right = hop.join(e, F.col("_hb") == F.col("_key")).select(F.col("_ha").alias("_a"), F.col("_row").alias(rel), var)
        st.df = df.withColumn("_at", F.col(at)).join(right, F.col("_at") == F.col("_a"), "left").drop("_at", "_a")
        st.nodes.add(var)
        st.rels.add(rel)

    def _where(self, st: _State) -> None:
        if self._word("WHERE"):
            st.df = st.df.where(self._expr(st))

    def _project(self, st: _State, final: bool) -> DataFrame:
        distinct = self._word("DISTINCT")
        items: list[tuple[str, Column, bool, str]] = []
        while True:
            start = self.i
            if self._op("*"):
                raise Unsupported("RETURN * is not supported; name the columns")
            self.aggregated = False
            c = self._expr(st)
            text = "".join(t for _, t in self.toks[start : self.i])
            raw = text
            if self._word("AS"):
                text = self._name()
            items.append((text, c, self.aggregated, raw))
            if not self._op(","):
                break
        if any(a for _, _, a, _ in items):
            keys = [c.alias(t) for t, c, a, _ in items if not a]
            out = st.df.groupBy(*keys).agg(*[c.alias(t) for t, c, a, _ in items if a]).select(*[F.col(f"`{t}`") for t, *_ in items])
        else:
            out = st.df.select(*[c.alias(t) for t, c, _, _ in items])
        out = out.distinct() if distinct else out
        new = _State(df=out)
        for t, _, a, raw in items:
            if not a and raw in st.nodes:
                new.nodes.add(t)
            elif not a and raw in st.rels:
                new.rels.add(t)
            else:
                new.values[t] = t
        self.result = new
        if not final:
            self._where(new)
        if distinct or any(a for _, _, a, _ in items) or self._peek().upper() != "ORDER" or new.df is not out:
            out = self._order(new)
        else:  # what is ordered by need not be returned
            cols = [f"_out{k}" for k in range(len(items))]
            both = _State(st.df.select("*", *[c.alias(o) for (_, c, _, _), o in zip(items, cols)]), set(st.nodes), set(st.rels), dict(st.values))
            for (t, _, _, raw), o in zip(items, cols):
                if t != raw:
                    both.nodes.discard(t)
                    both.rels.discard(t)
                    both.values[t] = o
            out = self._order(both).select(*[F.col(o).alias(t) for (t, *_), o in zip(items, cols)])
        if not final:
            new.df = out
            self._where(new)
            out = new.df
        st.df, st.nodes, st.rels, st.values = out, new.nodes, new.rels, new.values
        return out

    def _order(self, st: _State) -> DataFrame:
        out = st.df
        if self._word("ORDER"):
            if not self._word("BY"):
                raise Unsupported("ORDER without BY")
            cols = []
            while True:
                c = self._expr(st)
                cols.append(c.desc() if self._word("DESC") or self._word("DESCENDING") else c.asc())
                self._word("ASC")
                if not self._op(","):
                    break
            out = out.orderBy(*cols)
        if self._word("SKIP"):
            out = out.offset(int(self._peek()))
            self.i += 1
        if self._word("LIMIT"):
            out = out.limit(int(self._peek()))
            self.i += 1
        return out

    # expressions, loosest binding first
    def _expr(self, st: _State) -> Column:
        c = self._and(st)
        while self._word("OR"):
            c = c | self._and(st)
        return c

    def _and(self, st: _State) -> Column:
        c = self._not(st)
        while self._word("AND"):
            c = c & self._not(st)
        return c

    def _not(self, st: _State) -> Column:
        return ~self._not(st) if self._word("NOT") else self._compare(st)

    def _compare(self, st: _State) -> Column:
        c = self._sum(st)
        for op, f in (("=", lambda a, b: a == b), ("<>", lambda a, b: a != b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b)):
            if self._op(op):
                return f(c, self._sum(st))
        if self._word("IN"):
            return F.array_contains(self._sum(st), c)
        if self._word("CONTAINS"):
            return F.contains(c, self._sum(st))
        if self._word("STARTS"):
            self._word("WITH")
            return F.startswith(c, self._sum(st))
        if self._word("ENDS"):
            self._word("WITH")
            return F.endswith(c, self._sum(st))
        if self._word("IS"):
            no = self._word("NOT")
            self._word("NULL")
            return c.isNotNull() if no else c.isNull()
        return c

    def _sum(self, st: _State) -> Column:
        c = self._atom(st)
        while self._peek() in ("+", "-", "*", "/") and self.toks[self.i][0] == "op":
            op = self._peek()
            self.i += 1
            d = self._atom(st)
            c = c + d if op == "+" else c - d if op == "-" else c * d if op == "*" else c / d
        return c

    def _atom(self, st: _State) -> Column:
        c = self._plain_atom(st)
        while self._peek() == "[" and self.i and self.toks[self.i - 1][1] in (")", "]") or self._peek() == "[" and self.i and self.toks[self.i - 1][0] == "name" and self.toks[self.i - 1][1].upper() != "IN":
            self._need("[")
            lo = None if self._peek() == ".." else self._expr(st)
            if self._op(".."):
                hi = None if self._peek() == "]" else self._expr(st)
                begin = F.lit(0) if lo is None else lo
                c = F.slice(c, begin + 1, F.greatest((F.size(c) if hi is None else hi) - begin, F.lit(0)))
            else:
                c = F.get(c, lo)
            self._need("]")
        return c

    def _case(self, st: _State) -> Column:
        of = None if self._peek().upper() == "WHEN" else self._expr(st)
        out = None
        while self._word("WHEN"):
            cond = self._expr(st)
            if not self._word("THEN"):
                raise Unsupported("WHEN without THEN")
            value = self._expr(st)
            cond = cond if of is None else of == cond
            out = F.when(cond, value) if out is None else out.when(cond, value)
        if out is None:
            raise Unsupported("CASE without WHEN")
        if self._word("ELSE"):
            out = out.otherwise(self._expr(st))
        if not self._word("END"):
            raise Unsupported("CASE without END")
        return out

    def _plain_atom(self, st: _State) -> Column:
        if self.i >= len(self.toks):
            raise Unsupported("the statement ends too early")
        kind, t = self.toks[self.i]
        self.i += 1
        if kind == "str":
            return F.lit(re.sub(r"\\(.)", r"\1", t[1:-1]))
        if kind == "num":
            return F.lit(float(t) if "." in t else int(t))
        if kind == "param":
            if t[1:] not in self.params:
                raise Unsupported(f"no parameter {t}")
            return _parameter(self.params[t[1:]])
        if t == "(":
            c = self._expr(st)
            self._need(")")
            return c
        if t == "[":
            items = []
            while not self._op("]"):
                items.append(self._expr(st))
                self._op(",")
            return F.array(*items)
        if kind != "name":
            raise Unsupported(f"unexpected: {t}")
        name = t.strip("`")
        if name.upper() in ("TRUE", "FALSE", "NULL"):
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[name.upper()])
        if name.upper() == "CASE":
            return self._case(st)
        if name == "vec" and self._peek() == "." and name not in st.nodes:
            self.i += 1
            f = "vec." + self._name()
            self._need("(")
            return self._call(st, f)
        if self._op("("):
            return self._call(st, name)
        if name not in st.nodes | st.rels and name not in st.values:
            raise Unsupported(f"unknown variable {name}")
        col = name if name in st.nodes | st.rels else st.values[name]
        return F.col(f"`{col}`.`{self._name()}`") if self._op(".") else F.col(f"`{col}`")

    def _call(self, st: _State, name: str) -> Column:
        f = name.lower()
        if f == "count" and self._op("*"):
            self._need(")")
            self.aggregated = True
            return F.count("*")
        distinct = self._word("DISTINCT")
        start, args = self.i, []
        outer = getattr(self, "aggregated", False)
        while not self._op(")"):
            args.append(self._expr(st))
            self._op(",")
        arg = self.toks[start][1]
        if f in AGGREGATES:
            self.aggregated = True
            a = F.col(f"`{arg}`.`name`") if arg in st.nodes and self.toks[start + 1][1] == ")" else args[0]
            if f == "count":
                return F.count_distinct(a) if distinct else F.count(a)
            if f == "collect":
                return F.sort_array(F.collect_set(a) if distinct else F.collect_list(a))
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[f](a)
        self.aggregated = outer or self.aggregated
        if f == "size":
            return F.size(args[0])
        if f == "vecf32":
            return args[0].cast("array<float>")
        if f == "vec.cosinedistance":
            return 1 - cosine(args[0], args[1])
        if f == "properties":
            if arg not in st.nodes | st.rels:
                raise Unsupported("properties() takes a node or a relation")
            kinds = (self.entities if arg in st.nodes else self.edges).dtypes
            plain = [c for c, k in kinds if c not in ("_key", "edge_id") and not k.startswith(("array", "map", "struct", "binary"))]
            pairs = [x for c in plain for x in (F.lit(c), F.col(f"`{arg}`.`{c}`").cast("string"))]
            return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
        if f in ("tolower", "toupper"):
            return (F.lower if f == "tolower" else F.upper)(args[0])
        if f == "coalesce":
            return F.coalesce(*args)
        if f == "type":
            return F.col(f"`{arg}`.`rel`")
        if f == "labels":
            return F.array(F.col(f"`{arg}`.`type`"))
        if f == "id":
            return F.col(f"`{arg}`.`edge_id`") if arg in st.rels else F.xxhash64(F.col(f"`{arg}`.`name`"))
        if f in ("startnode", "endnode"):
            return F.col(f"`{arg}`.`{'src' if f == 'startnode' else 'dst'}`")
        raise Unsupported(f"unknown function {name}")


def _parameter(v) -> Column:
    """A parameter as a literal; maps, and lists of them, by way of JSON."""
    if isinstance(v, dict) or isinstance(v, (list, tuple)) and any(isinstance(x, dict) for x in v):
        text = json.dumps(v)
        return F.from_json(F.lit(text), F.schema_of_json(F.lit(text)))
    return F.lit(v)


def query(entities: DataFrame, edges: DataFrame, text: str, params: dict | None = None, chunks: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """The rows of a statement; entities: (name, type, ...), edges: (src, rel, dst, ...); chunks and mentions for the procedures that search them."""
    return Compiler(entities, edges, params, chunks, mentions).run(text)
