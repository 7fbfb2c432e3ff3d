"""Analyses of a program's facts: modules, calls, data flow, metrics, history, packages.

`Code` takes the fact tables as DataFrames with the columns named in each method; every method is a plan over them. Tables that an
analysis doesn't touch need not be there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import graphs


def ratio(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.col(b).cast("double")


def counted(keys: DataFrame, rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Each key with its number of distinct rows, 0 where there are none."""
    return keys.select(*by).distinct().join(rows.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name)), list(by), "left").fillna(0, [name])


class Code:
    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    # modules: imports(file, target_file, target_package, runtime, kind), file(path, package, namespace, …), file_ancestor(file, dir, depth)

    def file_dep(self) -> DataFrame:
        return self["imports"].where("target_file IS NOT NULL AND file <> target_file").select(F.col("file").alias("a"), F.col("target_file").alias("b"), "kind").distinct()

    def dep(self) -> DataFrame:
        return self.file_dep().select("a", "b").distinct()

    def runtime_dep(self) -> DataFrame:
        """Imports that run: marked so, or unmarked and not for types alone."""
        kept = F.col("runtime") | (F.col("runtime").isNull() & ~F.col("kind").isin("type_only", "type_query"))
        return self["imports"].where("target_file IS NOT NULL AND file <> target_file").where(kept).select(F.col("file").alias("a"), F.col("target_file").alias("b")).distinct()

    def lifted(self, edges: DataFrame, of: DataFrame) -> DataFrame:
        """Edges between files as edges between what `of` (path, unit[, level]) puts them in; only edges that cross, within a level."""
        level = of.columns[2:]
        left, right = of.toDF("a", "ua", *level), of.toDF("b", "ub", *level)
        return edges.join(left, "a").join(right, ["b", *level]).where("ua <> ub").select(*level, "ua", "ub").distinct()

    def unit_dep(self) -> DataFrame:
        return self.lifted(self.dep(), self["file_ancestor"].select("file", "dir", "depth"))

    def package_edge(self) -> DataFrame:
        return self.lifted(self.dep(), self["file"].select("path", "package"))

    def namespace_dep(self) -> DataFrame:
        return self.lifted(self.dep(), self["file"].select("path", "namespace"))

    def external_dep(self) -> DataFrame:
        return self["imports"].where("target_package IS NOT NULL").select("file", "target_package").distinct()

    @cached_property
    def file_reaches(self) -> DataFrame:
        return graphs.closure(self.dep())

    def in_cycle(self) -> DataFrame:
        return self.file_reaches.where("a = b").select(F.col("a").alias("file"))

    def cycle_edge(self) -> DataFrame:
        return self.dep().join(self.file_reaches.toDF("b", "a"), ["a", "b"], "left_semi")

    def in_namespace_cycle(self) -> DataFrame:
        return graphs.closure(self.namespace_dep()).where("a = b").select(F.col("a").alias("namespace"))

    # calls: call_site(id, caller, callee, dispatch), overrides(member, base), symbol(id, kind, name, parent, file, …)

    @cached_property
    def overridden_by(self) -> DataFrame:
        """(base, member), through chains of overriding."""
        return graphs.closure(self["overrides"].select("base", "member")).toDF("base", "member")

    def call_edge_declared(self) -> DataFrame:
        return self["call_site"].where("dispatch IN ('static', 'virtual') AND callee IS NOT NULL").select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()

    def call_edge(self) -> DataFrame:
        """Declared targets, and for virtual calls everything that overrides them."""
        virtual = self["call_site"].where("dispatch = 'virtual'").select(F.col("caller").alias("a"), F.col("callee").alias("base"))
        return self.call_edge_declared().union(virtual.join(self.overridden_by, "base").select("a", F.col("member").alias("b"))).distinct()

    def nested_anonymous(self) -> DataFrame:
        """(outer, fn): anonymous functions within a named function or within each other, object literals between them skipped."""
        s = self["symbol"]
        inner = s.where("(kind = 'function' AND name IN ('<arrow>', '<function>')) AND parent IS NOT NULL").select(F.col("id").alias("fn"), F.col("parent").alias("up"))
        objects = s.where("kind = 'object' AND name = '<object>'").select(F.col("id").alias("up"), F.col("parent").alias("next"))
        climbed = graphs.grow(inner, lambda new, _: new.join(objects.where("next IS NOT NULL"), "up").select("fn", F.col("next").alias("up")), "climb")
        return graphs.closure(climbed.join(objects.select("up"), "up", "left_anti").select("up", "fn")).toDF("outer", "fn")

    def call_edge_lexical(self) -> DataFrame:
        """Calls, those of anonymous functions also as their surroundings' calls."""
        calls = self.call_edge()
        return calls.union(self.nested_anonymous().join(calls.toDF("fn", "b"), "fn").select("outer", "b")).distinct()

    @cached_property
    def reaches(self) -> DataFrame:
        return graphs.closure(self.call_edge())

    def recursive(self) -> DataFrame:
        return self.reaches.where("a = b").select(F.col("a").alias("fn"))

    def mutual(self) -> DataFrame:
        return self.reaches.where("a < b").join(self.reaches.toDF("b", "a"), ["a", "b"], "left_semi")

    def reaches_from(self, seeds: DataFrame) -> DataFrame:
        return graphs.reach_from(self.call_edge(), seeds)

    # flow: flow_node(id, fn, kind, line), flow_edge(from, to), def(node, var), use(node, var), captures(var)

    def arcs(self) -> DataFrame:
        return self["flow_edge"].select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()

    def entries(self) -> DataFrame:
        return self["flow_node"].where("kind = 'entry'")

    @cached_property
    def reachable(self) -> DataFrame:
        return graphs.reach(self.arcs(), self.entries().select("id"))

    def unreachable(self, statements: tuple[str, ...]) -> DataFrame:
        """(fn, id, line) of nodes of the given kinds that no entry reaches."""
        return self["flow_node"].where(F.col("kind").isin(*statements)).join(self.reachable.toDF("id"), "id", "left_anti").select("fn", "id", "line").distinct()

    @cached_property
    def rd_in(self) -> DataFrame:
        return graphs.reaching(self["def"].select("node", "var"), self.arcs())

    def def_use(self) -> DataFrame:
        return self.rd_in.join(self["use"].select("node", "var").distinct(), ["node", "var"]).select("definition", F.col("node").alias("use"), "var")

    def undefined_use(self) -> DataFrame:
        """Uses of a function's own locals, at reachable nodes, that no definition reaches."""
        local = self["symbol"].where("kind = 'local'").select(F.col("id").alias("var"), F.col("parent").alias("fn"))
        own = self["use"].select("node", "var").join(self["flow_node"].select(F.col("id").alias("node"), "fn"), "node").join(local, ["var", "fn"])
        return own.join(self.reachable, "node", "left_semi").join(self.rd_in.select("node", "var"), ["node", "var"], "left_anti").select("node", "var").distinct()

    @cached_property
    def live_in(self) -> DataFrame:
        return graphs.live(self["use"].select("node", "var"), self["def"].select("node", "var"), self.arcs())

    def dead_store(self) -> DataFrame:
        """(node, var, line): definitions of uncaptured locals that nothing can use."""
        local = self["symbol"].where("kind = 'local'").select(F.col("id").alias("var"))
        stores = self["def"].select("node", "var").join(local, "var", "left_semi").join(self["captures"].select("var"), "var", "left_anti")
        idle = stores.join(graphs.live_out(self.live_in, self.arcs()), ["node", "var"], "left_anti")
        return idle.join(self["flow_node"].select(F.col("id").alias("node"), "line"), "node").select("node", "var", "line").distinct()

    @cached_property
    def dominates(self) -> DataFrame:
        return graphs.dominators(self["flow_node"].select("fn", "id"), self.arcs(), self.entries().select("fn", "id"))

    def loop_header(self) -> DataFrame:
        heads = graphs.back_edges(self.arcs(), self.dominates).select(F.col("b").alias("id")).distinct()
        return self["flow_node"].join(heads, "id").select("fn", "id").distinct()

    # types: extends(child, parent), fn(id, cyclomatic), child(parent, member), is_type and type_dep(a, b) given as tables

    def project_classes(self) -> DataFrame:
        return self["symbol"].where("kind = 'class' AND origin = 'project'").select(F.col("id").alias("class"))

    def members(self) -> DataFrame:
        return self["symbol"].where("parent IS NOT NULL").select(F.col("parent").alias("class"), F.col("id").alias("member"))

    def dit(self) -> DataFrame:
        """Depth of inheritance: ancestors of each class."""
        return counted(self.project_classes(), graphs.closure(self["extends"].select("child", "parent")).toDF("class", "ancestor"), "class")

    def noc(self) -> DataFrame:
        return counted(self.project_classes(), self["extends"].select(F.col("parent").alias("class"), "child"), "class")

    def class_body(self) -> DataFrame:
        return self.project_classes().join(self.members(), "class").join(self["fn"].select(F.col("id").alias("member")), "member", "left_semi").select("class", "member").distinct()

    def wmc(self) -> DataFrame:
        """Sum of the methods' cyclomatic complexities; NULL without methods."""
        return self.project_classes().join(self.class_body().join(self["fn"].select(F.col("id").alias("member"), "cyclomatic"), "member").groupBy("class").agg(F.sum("cyclomatic").alias("n")), "class", "left")

    def rfc(self) -> DataFrame:
        body = self.class_body()
        return counted(self.project_classes(), body.union(body.join(self.call_edge().toDF("member", "b"), "member").select("class", "b")), "class")

    def fan_out(self) -> DataFrame:
        return counted(self["fn"].select(F.col("id").alias("fn")), self.call_edge().toDF("fn", "b"), "fn")

    def fan_in(self) -> DataFrame:
        return counted(self["fn"].select(F.col("id").alias("fn")), self.call_edge().select(F.col("b").alias("fn"), "a"), "fn")

    # coupling of components at several grains: file_member(file, grain, comp), ref(from, to, kind, line)

    def file_ref(self) -> DataFrame:
        s = self["symbol"].select("id", "file")
        return self["ref"].join(s.toDF("from", "fa"), "from").join(s.toDF("to", "fb"), "to").where("fa <> fb")

    def comp_edge(self) -> DataFrame:
        return self.lifted(self.file_ref().select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct(), self["file_member"].select("file", "comp", "grain")).toDF("grain", "a", "b")

    def comp_edge_weight(self) -> DataFrame:
        m = self["file_member"].select("file", "grain", "comp")
        crossing = self.file_ref().join(m.toDF("fa", "grain", "a"), "fa").join(m.toDF("fb", "grain", "b"), ["fb", "grain"]).where("a <> b")
        return crossing.select("grain", "a", "b", "from", "to", "kind", "line").distinct().groupBy("grain", "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def comps(self) -> DataFrame:
        return self["file_member"].select("grain", "comp").distinct()

    def efferent(self) -> DataFrame:
        return counted(self.comps(), self.comp_edge().toDF("grain", "comp", "b"), "grain", "comp")

    def afferent(self) -> DataFrame:
        return counted(self.comps(), self.comp_edge().toDF("grain", "a", "comp"), "grain", "comp")

    def instability(self) -> DataFrame:
        both = self.efferent().withColumnRenamed("n", "e").join(self.afferent().withColumnRenamed("n", "a"), ["grain", "comp"])
        return both.withColumn("t", F.col("e") + F.col("a")).where("t > 0").select("grain", "comp", ratio("e", "t").alias("instability"))

    def abstractness(self) -> DataFrame:
        kinds = self["symbol"].where("kind IN ('class', 'interface') AND origin = 'project'").select("id", "file", ((F.col("kind") == "interface") | F.coalesce(F.col("is_abstract"), F.lit(False))).cast("int").alias("abstract"))
        placed = kinds.join(self["file_member"], "file").select("grain", "comp", "id", "abstract").distinct()
        return placed.groupBy("grain", "comp").agg((F.sum("abstract") / F.count(F.lit(1))).alias("abstractness"))

    def distance(self) -> DataFrame:
        return self.abstractness().join(self.instability(), ["grain", "comp"]).select("grain", "comp", F.abs(F.col("abstractness") + F.col("instability") - 1.0).alias("distance"))

    def sdp_violation(self) -> DataFrame:
        """Edges from a more to a less stable component."""
        i = self.instability()
        return self.comp_edge().join(i.toDF("grain", "a", "ia"), ["grain", "a"]).join(i.toDF("grain", "b", "ib"), ["grain", "b"]).where("ib > ia").select("grain", "a", "b")

    def cbo(self) -> DataFrame:
        t = self["type_dep"].toDF("type", "b")
        return counted(self["is_type"].toDF("type"), t.union(t.select("b", "type")), "type")

    # cohesion: member_access(fn, member, owner, via_this)

    def methods(self) -> DataFrame:
        kinds = self["symbol"].where("kind IN ('method', 'getter', 'setter') AND NOT is_static").select(F.col("id").alias("method"), F.col("parent").alias("class"))
        return kinds.join(self.project_classes(), "class").select("class", "method")

    def fields(self) -> DataFrame:
        kinds = self["symbol"].where("kind = 'property' AND NOT is_static").select(F.col("id").alias("field"), F.col("parent").alias("class"))
        return kinds.join(self.project_classes(), "class").select("class", "field")

    @cached_property
    def own_access(self) -> DataFrame:
        """(class, method, member): members that a method, or a function within it, reaches through its own object."""
        arcs = self["symbol"].where("parent IS NOT NULL").select(F.col("parent").alias("fn"), F.col("id").alias("inner"))
        inside = graphs.grow(self.methods().select("method", F.col("method").alias("fn")), lambda new, _: new.join(arcs, "fn").select("method", F.col("inner").alias("fn")), "within")
        seen = self["member_access"].where("via_this").select("fn", "member", F.col("owner").alias("class"))
        return seen.join(inside, "fn").join(self.methods(), ["class", "method"]).select("class", "method", "member").distinct()

    def uses(self) -> DataFrame:
        return self.own_access.join(self.fields().toDF("class", "member"), ["class", "member"]).select("class", "method", F.col("member").alias("field"))

    def lcom4(self) -> DataFrame:
        """Groups of methods that share fields or call each other."""
        u = self.uses()
        hubs = u.select("method", F.concat(F.lit("field "), F.col("field").cast("string")).alias("hub"))
        first = hubs.groupBy("hub").agg(F.min("method").alias("one"))
        shared = hubs.join(first, "hub").select("one", "method")
        calls = self.own_access.join(self.methods().toDF("class", "member"), ["class", "member"]).select("method", "member")
        rooted = graphs.groups(shared.union(calls), self.methods().select("method"))
        return counted(self.project_classes(), self.methods().join(rooted.toDF("method", "root"), "method").select("class", "root"), "class")

    def tcc(self) -> DataFrame:
        """Share of method pairs that use a common field."""
        m, u = self.methods(), self.uses()
        pairs = m.groupBy("class").agg(F.count(F.lit(1)).alias("m")).withColumn("pairs", F.expr("m * (m - 1) div 2")).where("pairs > 0")
        sharing = u.join(u.toDF("class", "other", "field"), ["class", "field"]).where("method < other").select("class", "method", "other")
        return counted(pairs, sharing, "class", name="shared").join(pairs, "class").select("class", ratio("shared", "pairs").alias("tcc"))

    def lcom_hs(self) -> DataFrame:
        """Henderson-Sellers' lack of cohesion, of classes with fields and more than one method."""
        n = counted(self.project_classes(), self.methods(), "class", name="methods").join(counted(self.project_classes(), self.fields(), "class", name="fields"), "class").where("methods > 1 AND fields > 0")
        used = counted(self.project_classes(), self.uses().select("class", "method", "field"), "class", name="uses")
        mean = F.col("uses") / F.col("fields")
        return n.join(used, "class").select("class", ((mean - F.col("methods")) / (1.0 - F.col("methods"))).alias("lcom_hs"))

    # points-to: alloc(var, site, kind, type, fn_target), assign(to, from, kind), load(to, base, field), store(base, field, from),
    # actual(call_site, index, var), formal(fn, index, var), actual_ret(call_site, var), formal_ret(fn, var), callee_var(call_site, var), receiver, this_var, var

    @cached_property
    def points_to(self) -> dict[str, DataFrame]:
        """pts(var, site), heap(site, field, value) and target(call_site, fn), which depend on each other, as one tagged relation (kind, x, y, z)."""
        alloc, cs = self["alloc"], self["call_site"]
        text = lambda *c: [F.col(x).cast("string") for x in c]
        tag = lambda kind, frame, x, y, z=None: frame.select(F.lit(kind).alias("kind"), *[(F.col(c).cast("string") if c else F.lit("")).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])
        sub = graphs.closure(self["extends"].select("child", "parent")).toDF("type", "fn").union(self["symbol"].where("kind = 'class'").select("id", "id"))
        this = self["var"].where("kind = 'this'").select(F.col("id").alias("var"), "fn")
        own = alloc.where("kind = 'instance'").select("site", "type").join(sub, "type").join(this, "fn").select("var", "site")
        static = cs.where("dispatch IN ('static', 'virtual') AND callee IS NOT NULL").select("id", "callee")
        virtual = cs.where("dispatch = 'virtual'").select("id", F.col("callee").alias("base")).join(self.overridden_by, "base").select("id", "member")
        seed = tag("pts", alloc, "var", "site").union(tag("pts", own, "var", "site")).union(tag("target", static, "id", "callee")).union(tag("target", virtual, "id", "member"))
        copy = self["assign"].where("kind = 'copy'").select(*text("from", "to"))
        functions = alloc.where("kind IN ('function', 'class') AND fn_target IS NOT NULL").select(*text("site", "fn_target"))
        calls = self["callee_var"].select(*text("call_site", "var"))
        store, load = self["store"].select(*text("base", "field", "from")), self["load"].select(*text("to", "base", "field"))
        # what a call passes: (call site, function, from variable, to variable) through a target
        args = self["actual"].select(*text("call_site", "index", "var")).toDF("cs", "index", "from").join(self["formal"].select(*text("fn", "index", "var")).toDF("fn", "index", "to"), "index").select("cs", "fn", "from", "to")
        returns, results = self["formal_ret"].select(*text("fn", "var")).toDF("fn", "from"), self["actual_ret"].select(*text("call_site", "var")).toDF("cs", "to")
        thises, receivers = self["this_var"].select(*text("fn", "var")).toDF("fn", "to"), self["receiver"].select(*text("call_site", "var")).toDF("cs", "from")

        def passed(targets: DataFrame) -> DataFrame:
            """(from, to): copies that the targets make."""
            t = targets.select(F.col("x").alias("cs"), F.col("y").alias("fn"))
            return t.join(args, ["cs", "fn"]).select("from", "to").union(t.join(returns, "fn").join(results, "cs").select("from", "to")).union(t.join(thises, "fn").join(receivers, "cs").select("from", "to"))

        def rows(frame: DataFrame, kind: str) -> DataFrame:
            return frame.where(F.col("kind") == kind)

        def step(new, every):
            out = None
            # a premise is new in one of two places; the other reads all
            for pts, heap, targets, fresh in ((rows(new, "pts"), rows(every, "heap"), rows(every, "target"), True), (rows(every, "pts"), rows(new, "heap"), rows(new, "target"), False)):
                p = pts.select(F.col("x").alias("from"), F.col("y").alias("site"))
                moved = p.join(passed(targets).distinct(), "from").select(F.col("to").alias("var"), "site")
                loaded = load.join(pts.select(F.col("x").alias("base"), F.col("y").alias("site")), "base").join(heap.select(F.col("x").alias("site"), F.col("y").alias("field"), F.col("z").alias("value")), ["site", "field"]).select(F.col("to").alias("var"), F.col("value").alias("site"))
                made = tag("pts", moved.union(loaded), "var", "site")
                if fresh:
                    made = made.union(tag("pts", p.join(copy, "from").select(F.col("to").alias("var"), "site"), "var", "site"))
                    called = calls.join(pts.select(F.col("x").alias("var"), F.col("y").alias("site")), "var").join(functions, "site").select("call_site", "fn_target")
                    made = made.union(tag("target", called, "call_site", "fn_target"))
                    everything = rows(every, "pts")
                    for base, value in ((pts, everything), (everything, pts)):
                        stored = store.join(base.select(F.col("x").alias("base"), F.col("y").alias("site")), "base").join(value.select(F.col("x").alias("from"), F.col("y").alias("value")), "from").select("site", "field", "value")
                        made = made.union(tag("heap", stored, "site", "field", "value"))
                out = made if out is None else out.union(made)
            return out

        found = graphs.grow(seed, step, "points")
        return {
            "pts": rows(found, "pts").select(F.col("x").alias("var"), F.col("y").alias("site")),
            "heap": rows(found, "heap").select(F.col("x").alias("site"), F.col("y").alias("field"), F.col("z").alias("value")),
            "target": rows(found, "target").select(F.col("x").alias("call_site"), F.col("y").alias("fn")),
        }

    def call_edge_pt(self) -> DataFrame:
        return self["call_site"].select(F.col("id").cast("string").alias("call_site"), "caller").join(self.points_to["target"], "call_site").select("caller", "fn").distinct()

    def unresolved_call(self) -> DataFrame:
        return self["call_site"].where("dispatch = 'indirect'").select(F.col("id").cast("string").alias("call_site")).join(self.points_to["target"], "call_site", "left_anti")

    def tainted(self, sources: DataFrame, extra_steps: DataFrame | None = None) -> DataFrame:
        """(var): what flows from the sources through assignments, the heap and calls; calls without a known target, or into libraries, pass all arguments on."""
        p = self.points_to
        steps = self["assign"].select(F.col("from").alias("a"), F.col("to").alias("b"))
        stored = self["store"].select("base", "field", F.col("from").alias("a")).join(p["pts"].toDF("base", "site"), "base")
        loaded = self["load"].select(F.col("to").alias("b"), "base", "field").join(p["pts"].toDF("base", "site"), "base")
        steps = steps.union(stored.select("site", "field", "a").join(loaded.select("site", "field", "b"), ["site", "field"]).select("a", "b"))
        actual = self["actual"].select(F.col("call_site").cast("string").alias("call_site"), "index", F.col("var").alias("a"))
        t = p["target"]
        steps = steps.union(t.join(actual, "call_site").join(self["formal"].select("fn", "index", F.col("var").alias("b")), ["fn", "index"]).select("a", "b"))
        results = self["actual_ret"].select(F.col("call_site").cast("string").alias("call_site"), F.col("var").alias("b"))
        steps = steps.union(t.join(self["formal_ret"].select("fn", F.col("var").alias("a")), "fn").join(results, "call_site").select("a", "b"))
        sites = self["call_site"].select(F.col("id").cast("string").alias("call_site"), "callee")
        foreign = self["symbol"].where("origin IN ('lib', 'external')").select(F.col("id").alias("callee"))
        opaque = sites.join(t, "call_site", "left_anti").select("call_site").union(sites.join(foreign, "callee").select("call_site")).distinct()
        steps = steps.union(opaque.join(actual, "call_site").join(results, "call_site").select("a", "b"))
        return graphs.reach((steps if extra_steps is None else steps.union(extra_steps)).distinct(), sources)

    # history: commit(sha, email, time, files), touch(sha, path_now, added, deleted)

    def changed(self, bulk: int = 50) -> DataFrame:
        """(sha, file) of commits that touch at most `bulk` files."""
        small = self["commit"].where(F.col("files") <= bulk).select("sha")
        return self["touch"].where("path_now IS NOT NULL").select("sha", F.col("path_now").alias("file")).join(self["file"].select(F.col("path").alias("file")), "file", "left_semi").join(small, "sha", "left_semi").distinct()

    def revisions(self) -> DataFrame:
        return counted(self["file"].select(F.col("path").alias("file")), self.changed(), "file")

    def cochange(self) -> DataFrame:
        c = self.changed()
        return c.toDF("sha", "a").join(c.toDF("sha", "b"), "sha").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    def confidence(self) -> DataFrame:
        pairs = self.cochange()
        both = pairs.union(pairs.select("b", "a", "n"))
        return both.join(self.revisions().toDF("a", "r"), "a").select("a", "b", ratio("n", "r").alias("confidence"))

    def hidden_coupling(self) -> DataFrame:
        """Files that change together without an import or reference between them."""
        refs = self.file_ref().select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        tied = self.dep().union(refs)
        tied = tied.union(tied.select("b", "a")).distinct()
        return self.cochange().join(tied, ["a", "b"], "left_anti")

    def churn(self, bulk: int = 50) -> DataFrame:
        small = self["commit"].where(F.col("files") <= bulk).select("sha")
        lines = self["touch"].join(small, "sha", "left_semi").groupBy(F.col("path_now").alias("file")).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
        return self["file"].select(F.col("path").alias("file")).join(lines, "file", "left")

    def main_author(self) -> DataFrame:
        """(file, email, share) of who made most of a file's changes; ties all count."""
        by = self.changed().join(self["commit"].select("sha", "email"), "sha").groupBy("file", "email").agg(F.count(F.lit(1)).alias("n"))
        most = by.groupBy("file").agg(F.max("n").alias("n"))
        return by.join(most, ["file", "n"]).join(self.revisions().withColumnRenamed("n", "r"), "file").select("file", "email", ratio("n", "r").alias("share"))

    def first_and_last_change(self) -> DataFrame:
        return self.changed().join(self["commit"].select("sha", "time"), "sha").groupBy("file").agg(F.min("time").alias("first"), F.max("time").alias("last"))

    # exports(file, name, symbol, kind) and entry points entry(file)

    def api_file(self) -> DataFrame:
        modules = self["symbol"].where("kind = 'module'").select(F.col("id").alias("symbol"), F.col("file").alias("target"))
        return graphs.reach(self["exports"].join(modules, "symbol").select("file", "target"), self["entry"].select("file")).toDF("file")

    def dead_export(self) -> DataFrame:
        """(file, name): local exports of source files that no other file, entry point or lazy import can reach."""
        used = self.file_ref().select(F.col("to").alias("symbol"))
        api = self["exports"].join(self.api_file(), "file", "left_semi").select("symbol")
        lazy = self["imports"].where("kind = 'dynamic' AND target_file IS NOT NULL").select(F.col("target_file").alias("file"))
        own = self["exports"].where("kind = 'local'").join(self["file"].where("NOT is_test").select(F.col("path").alias("file")), "file", "left_semi")
        return own.join(used, "symbol", "left_anti").join(api, "symbol", "left_anti").join(lazy, "file", "left_anti").select("file", "name").distinct()

    # packages: package_dep(package, dep, kind, types_for)

    def _imports(self) -> DataFrame:
        """(package, dep, file, is_test, runs) of imports of other packages; guessed targets count where they are declared."""
        runs = F.col("runtime") | (F.col("runtime").isNull() & ~F.col("kind").isin("type_only", "type_query"))
        own = self["file"].select(F.col("path").alias("file"), "package", "is_test").where("package IS NOT NULL")
        i = self["imports"].join(own, "file").withColumn("runs", F.coalesce(runs, F.lit(False)))
        sure = i.where("NOT builtin AND target_package <> package").select("package", F.col("target_package").alias("dep"), "file", "is_test", "runs")
        guess = i.where("unresolved_package <> package").select("package", F.col("unresolved_package").alias("dep"), "file", "is_test", "runs")
        known = self["package_dep"].select("package", "dep").union(self["package_dep"].where("types_for IS NOT NULL").select("package", "types_for")).distinct()
        return sure.union(guess.join(known, ["package", "dep"], "left_semi").select(sure.columns)).distinct()

    def undeclared(self) -> DataFrame:
        """(package, dep, file): imported without being declared; for types alone a declared types package is enough."""
        declared = self["package_dep"].select("package", "dep").distinct()
        types = self["package_dep"].where("types_for IS NOT NULL").select("package", F.col("types_for").alias("dep"))
        missing = self._imports().join(declared, ["package", "dep"], "left_anti")
        return missing.where("runs").select("package", "dep", "file").union(missing.join(types, ["package", "dep"], "left_anti").select("package", "dep", "file")).distinct()

    def unused(self) -> DataFrame:
        """(package, dep, kind): declared and not imported, directly, by file within the workspace, or for types."""
        own = self["file"].select("path", "package")
        used = self._imports().select("package", "dep")
        across = self["imports"].select("file", "target_file").join(own.toDF("file", "package"), "file").join(own.toDF("target_file", "dep"), "target_file").select("package", "dep")
        d = self["package_dep"]
        typed = d.where("types_for IS NOT NULL").select("package", F.col("dep").alias("t"), F.col("types_for").alias("dep")).join(used.distinct(), ["package", "dep"], "left_semi").select("package", "t")
        node = self["imports"].where("builtin").select("file").join(own.toDF("file", "package"), "file").select("package").distinct()
        node = d.where("types_for = 'node'").select("package", "dep").join(node, "package", "left_semi")
        return d.select("package", "dep", "kind").distinct().join(used.union(across).union(typed).union(node).distinct(), ["package", "dep"], "left_anti")

    def _shipped(self) -> DataFrame:
        return self["package_dep"].where("kind IN ('prod', 'peer', 'optional')").select("package", "dep").distinct()

    def dev_in_production(self) -> DataFrame:
        dev = self["package_dep"].where("kind = 'dev'").select("package", "dep").distinct().join(self._shipped(), ["package", "dep"], "left_anti")
        return self._imports().where("runs AND NOT is_test").join(dev, ["package", "dep"], "left_semi").select("package", "dep", "file").distinct()

    def only_in_tests(self) -> DataFrame:
        seen = self._imports().groupBy("package", "dep").agg(F.bool_and("is_test").alias("tests")).where("tests")
        return self._shipped().join(seen, ["package", "dep"], "left_semi")

    def types_only(self) -> DataFrame:
        seen = self._imports().groupBy("package", "dep").agg(F.bool_or("runs").alias("runs")).where("NOT runs")
        return self._shipped().join(seen, ["package", "dep"], "left_semi")

    # summaries and integrity

    def summary(self) -> DataFrame:
        """(what, n): the tables' sizes, one row each."""
        out = None
        for name, frame in sorted(self.tables.items()):
            row = frame.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
            out = row if out is None else out.union(row)
        return out

    def violations(self, keys: dict[str, list[str]], references: list[tuple[str, str, str, str]], values: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
        """(check, subject): rows that share a key, point nowhere, or hold a value that isn't allowed.

        keys: columns that are unique in a table; references: (table, column, other table, its column); values: allowed ones by (table, column).
        """
        found = []
        for table, columns in keys.items():
            subject = F.concat_ws(", ", *[F.col(c).cast("string") for c in columns])
            found.append(self[table].groupBy(*columns).count().where("count > 1").select(F.lit(f"{table} repeats {', '.join(columns)}").alias("check"), subject.alias("subject")))
        for table, column, other, key in references:
            lost = self[table].where(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct().join(self[other].select(F.col(key).alias("k")), "k", "left_anti")
            found.append(lost.select(F.lit(f"{table}.{column} without {other}.{key}").alias("check"), F.col("k").cast("string").alias("subject")))
        for (table, column), allowed in (values or {}).items():
            odd = self[table].where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(F.col(column).cast("string").alias("subject")).distinct()
            found.append(odd.select(F.lit(f"{table}.{column} has another value").alias("check"), "subject"))
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out
