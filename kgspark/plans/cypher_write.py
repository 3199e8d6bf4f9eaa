"""Cypher statements that change a graph, as keyed merges of its tables: MERGE, SET, REMOVE, DELETE.

A statement reads rows (UNWIND, MATCH, WITH) and then writes for each: MERGE of a node by its name or of a
relation between two nodes, with ON CREATE SET and ON MATCH SET; SET of properties (n.p = value, n += {p: value});
REMOVE of properties; DELETE of relations and nodes (DETACH with their relations). The tables that result are new
DataFrames; storing them is the caller's. What many rows set on one node or relation is the greatest value;
rows that merge the same relation are one. Properties are columns; a new one is null elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.cypher import EVERY, Compiler, Unsupported, _State

EDGE = ("src", "rel", "dst")


class Writer(Compiler):
    def run(self, text: str) -> tuple[DataFrame, DataFrame]:
        """(entities, edges) after the statement."""
        self._tokens(text)
        st, wrote = _State(), False
        while self.i < len(self.toks):
            if self._word("UNWIND"):
                values = self._expr(st)
                if not self._word("AS"):
                    raise Unsupported("UNWIND without AS")
                name = self._name()
                base = st.df if st.df is not None else self._one()
                st.df, st.values[name] = base.withColumn(name, F.explode(values)), name
                continue
            if self._word("MATCH"):
                self._match(st, optional=False)
                continue
            if self._word("WITH"):
                self._project(st, final=False)
                continue
            wrote = True
            if self._word("MERGE"):
                self._merge(st)
            elif self._word("SET"):
                self._assign(st, self._items(st))
            elif self._word("REMOVE"):
                self._remove(st)
            elif self._word("DETACH"):
                self._word("DELETE")
                self._delete(st, detach=True)
            elif self._word("DELETE"):
                self._delete(st, detach=False)
            else:
                raise Unsupported(f"unsupported clause: {self._peek()}")
        if not wrote:
            raise Unsupported("the statement changes nothing")
        return self.entities.drop("_key"), self.edges.drop("edge_id")

    def _items(self, st: _State) -> list[tuple[str, str, Column]]:
        """(variable, property, value) of n.p = value and n += {p: value}."""
        out = []
        while True:
            var = self._name()
            if self._op("."):
                prop = self._name()
                self._need("=")
                out.append((var, prop, self._expr(st)))
            else:
                self._need("+")
                self._need("=")
                self._need("{")
                while not self._op("}"):
                    prop = self._name()
                    self._need(":")
                    out.append((var, prop, self._expr(st)))
                    self._op(",")
            if not self._op(","):
                return out

    def _assign(self, st: _State, items: list[tuple[str, str, Column]], only: Column | None = None) -> None:
        """Gives properties their values, where ``only`` holds."""
        for var in dict.fromkeys(v for v, _, _ in items):
            if var not in st.nodes | st.rels:
                raise Unsupported(f"unknown variable {var}")
            mine = {p: c for v, p, c in items if v == var}
            if set(mine) & {"name", *EDGE}:
                raise Unsupported("names and ends cannot be set")
            key = ("name",) if var in st.nodes else EDGE
            rows = st.df if only is None else st.df.where(only)
            new = rows.select(*[F.col(f"`{var}`.`{k}`").alias(k) for k in key], *[c.alias(f"_v_{p}") for p, c in mine.items()])
            new = new.groupBy(*key).agg(*[F.max(f"_v_{p}").alias(f"_v_{p}") for p in mine]).withColumn("_hit", F.lit(True))
            table = (self.entities if var in st.nodes else self.edges).join(new, list(key), "left")
            for p in mine:
                old = F.col(p) if p in table.columns else F.lit(None)
                table = table.withColumn(p, F.when(F.col("_hit"), F.col(f"_v_{p}")).otherwise(old)).drop(f"_v_{p}")
            self._keep(var in st.nodes, table.drop("_hit"))

    def _keep(self, nodes: bool, table: DataFrame) -> None:
        if nodes:
            self.entities = table
        else:
            self.edges = table

    def _remove(self, st: _State) -> None:
        while True:
            var = self._name()
            self._need(".")
            prop = self._name()
            table = self.entities if var in st.nodes else self.edges
            if prop in table.columns:
                self._assign(st, [(var, prop, F.lit(None).cast(dict(table.dtypes)[prop]))])
            if not self._op(","):
                return

    def _delete(self, st: _State, detach: bool) -> None:
        while True:
            var = self._name()
            if var in st.rels:
                gone = st.df.select(*[F.col(f"`{var}`.`{k}`").alias(k) for k in EDGE]).distinct()
                self.edges = self.edges.join(gone, list(EDGE), "left_anti")
            elif var in st.nodes:
                gone = st.df.select(F.col(f"`{var}`.`name`").alias("name")).distinct()
                left = self.edges
                for end in ("src", "dst"):
                    left = left.join(gone.withColumnRenamed("name", end), end, "left_anti")
                left = left.select(*self.edges.columns)
                if not detach and not self.edges.join(left.select(*EDGE), list(EDGE), "left_anti").isEmpty():
                    raise Unsupported("nodes with relations need DETACH DELETE")
                self.edges = left
                self.entities = self.entities.join(gone, "name", "left_anti")
            else:
                raise Unsupported(f"unknown variable {var}")
            if not self._op(","):
                return

    def _merge(self, st: _State) -> None:
        var, labels, props = self._node(st)
        if self._peek() not in ("-", "<-"):
            made = self._merge_node(st, var, labels, props)
            self._on(st, made)
            return
        rel, types, lo, hi, direction = self._rel()
        if len(types) != 1 or (lo, hi) != (1, 1) or direction == "both":
            raise Unsupported("MERGE of a relation needs one type and a direction")
        other, olabels, oprops = self._node(st)
        for v, ls, ps in ((var, labels, props), (other, olabels, oprops)):
            if v not in st.nodes:
                self._merge_node(st, v, ls, ps)
        a, b = (var, other) if direction == "out" else (other, var)
        key = st.df.select(F.col(f"`{a}`.`name`").alias("src"), F.lit(types[0]).alias("rel"), F.col(f"`{b}`.`name`").alias("dst")).distinct()
        have = self.edges.select(*EDGE, F.lit(True).alias("_old")).distinct()
        fresh = key.join(have, list(EDGE), "left_anti")
        old = self.edges
        self.edges = old.unionByName(fresh, allowMissingColumns=True).withColumn("edge_id", F.xxhash64(*EDGE))
        # the relation as it was before, so that r.weight + 1 has a weight to add to
        row = old.select(F.struct(*old.columns).alias("_row"), F.col("src").alias("_s"), F.col("dst").alias("_d")).where(F.col("_row.rel") == types[0])
        x = st.df.withColumns({"_a": F.col(f"`{a}`.`name`"), "_b": F.col(f"`{b}`.`name`")}).join(row, (F.col("_a") == F.col("_s")) & (F.col("_b") == F.col("_d")), "left")
        bare = F.struct(*[(F.col("_a") if c == "src" else F.col("_b") if c == "dst" else F.lit(types[0]) if c == "rel" else F.lit(None).cast(t)).alias(c) for c, t in old.dtypes])
        made = f"_made_{rel}"
        st.df = x.withColumn(made, F.col("_row").isNull()).withColumn(rel, F.coalesce("_row", bare)).drop("_a", "_b", "_s", "_d", "_row")
        st.rels.add(rel)
        self._on(st, F.col(made))

    def _merge_node(self, st: _State, var: str, labels: list, props: dict) -> Column:
        """Binds ``var`` to the node of that name, made if there is none; whether it was made."""
        if set(props) != {"name"}:
            raise Unsupported("MERGE of a node needs its name and nothing else; SET the rest")
        kind = next((x for x in labels if x not in EVERY), "concept")
        base = st.df if st.df is not None else self._one()
        made = f"_made_{var}"
        base = base.withColumn("_at", props["name"]).where("_at is not null")
        known = self.entities.select(F.col("name").alias("_at"), F.lit(False).alias(made)).distinct()
        base = base.join(known, "_at", "left").withColumn(made, F.coalesce(made, F.lit(True)))
        new = base.where(made).select(F.col("_at").alias("name")).distinct().withColumn("type", F.lit(kind))
        self.entities = self.entities.unionByName(new, allowMissingColumns=True).withColumn("_key", F.col("name"))
        e = self.entities.select(F.struct(*[c for c in self.entities.columns if c != "_key"]).alias(var), F.col("_key").alias("_k"))
        st.df = base.join(e, F.col("_at") == F.col("_k")).drop("_at", "_k")
        st.nodes.add(var)
        return F.col(made)

    def _on(self, st: _State, made: Column) -> None:
        while self._word("ON"):
            create = self._word("CREATE")
            if not create and not self._word("MATCH"):
                raise Unsupported("ON takes CREATE or MATCH")
            if not self._word("SET"):
                raise Unsupported("ON without SET")
            self._assign(st, self._items(st), made if create else ~made)


def update(entities: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after a statement that changes them; entities: (name, type, ...), edges: (src, rel, dst, ...)."""
    return Writer(entities, edges, params).run(text)
