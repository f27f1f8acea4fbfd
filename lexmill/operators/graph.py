"""The graph of cross-references within each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.forms import each


def pairs(refs: DataFrame) -> DataFrame:
    """(doc_id, src, dst): distinct edges but loops."""
    return refs.where("src <> dst").select("doc_id", "src", "dst").distinct()


def degrees(links: DataFrame) -> DataFrame:
    """(doc_id, v, n_in, n_out, conformity, modification) of articles with what they cite (doc_id, v, refs): distinct neighbours, and citations by kind.

    Each article gives a row of its own and one for either end of each citation, so that there is one pass over the articles and no join.
    """
    end = lambda v, side, other, kind: F.struct(v.alias("v"), F.lit(side).alias("side"), other.alias("other"), kind.alias("kind"))
    none = F.lit(None)
    own = F.array(end(F.col("v"), "own", none.cast("int"), none.cast("string")))
    out = F.transform("refs", lambda x: end(F.col("v"), "out", x["dst"], x["kind"]))
    back = F.transform("refs", lambda x: end(x["dst"], "in", F.col("v"), none.cast("string")))
    ends = each(links, F.concat(own, out, back), "x").select("doc_id", "x.v", "x.side", "x.other", "x.kind")
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    one = ends.groupBy("doc_id", "v", "side", "other").agg(of("conformity"), of("modification"))
    to = lambda side: F.count_if((F.col("side") == side) & (F.col("other") != F.col("v")))
    total = one.groupBy("doc_id", "v").agg(F.bool_or(F.col("side") == "own").alias("own"), to("in").alias("n_in"), to("out").alias("n_out"), F.sum("conformity").alias("conformity"), F.sum("modification").alias("modification"))
    return total.where("own").drop("own")


def listed(edges: Column) -> Column:
    """Edges (a, b) in order, as text."""
    return F.array_join(F.transform(F.array_sort(edges), lambda x: F.concat_ws("-", x["a"], x["b"])), ", ")


def _of_documents(links: DataFrame, fn, schema: str) -> DataFrame:
    """fn({v: set of others that it cites}) -> rows without doc_id, for the articles with what they cite of each document: one row, and no shuffle but that of documents."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, own, cited in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                after: dict[int, set[int]] = {}
                for v, to in zip(own, cited, strict=True):
                    after.setdefault(v, set()).update(to)
                    after[v].discard(v)
                out += [(doc, *r) for r in fn(after)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    rows = links.select("doc_id", F.struct("v", F.transform("refs", lambda x: x["dst"]).alias("to")).alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias("xs"))
    return rows.select("doc_id", "xs.v", "xs.to").mapInArrow(run, schema)


def nearness(links: DataFrame) -> DataFrame:
    """(doc_id, v, n, n_in, n_out, far_in, far_out, s): for each article the articles of its document, those that cite it or that it cites, the others from which it is reached or that it reaches, and the sum of the distances from all that reach it."""

    def run(after):
        near, far, back, behind, total = {}, {}, {}, {}, {}
        for s, to in after.items():
            if not to:
                continue
            near[s], d, seen, layer = len(to), 1, {s, *to}, to
            for w in to:
                back[w] = back.get(w, 0) + 1
                total[w] = total.get(w, 0) + 1
            while layer := {w for v in layer for w in after.get(v, ())} - seen:
                seen |= layer
                d += 1
                far[s] = far.get(s, 0) + len(layer)
                for w in layer:
                    behind[w] = behind.get(w, 0) + 1
                    total[w] = total.get(w, 0) + d
        n = len(after)
        return [(v, n, back.get(v, 0), near.get(v, 0), behind.get(v, 0), far.get(v, 0), total.get(v, 0)) for v in after]

    return _of_documents(links, run, "doc_id bigint, v int, n bigint, n_in bigint, n_out bigint, far_in bigint, far_out bigint, s bigint")


def bundles(links: DataFrame) -> DataFrame:
    """(doc_id, n_components, largest, n_vertices, n_edges, most_referenced): components and degrees of the articles of each document; cited articles that don't exist link those that cite them."""

    def run(after):
        up: dict[int, int] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        cited: dict[int, int] = {}
        for v, to in after.items():
            for w in to:
                cited[w] = cited.get(w, 0) + 1
                a, b = sorted((find(v), find(w)))
                up[b] = a
        sizes: dict[int, int] = {}
        for v in after:
            sizes[find(v)] = sizes.get(find(v), 0) + 1
        return [(len(sizes), max(sizes.values()), len(after), sum(map(len, after.values())), max(cited.get(v, 0) for v in after))]

    return _of_documents(links, run, "doc_id bigint, n_components bigint, largest bigint, n_vertices bigint, n_edges bigint, most_referenced bigint")


def _by_document(edges: DataFrame, fn, schema: str) -> DataFrame:
    """fn(list of (src, dst)) -> rows without doc_id, for the edges of each document.

    Rows come sorted by document and many documents to a batch, so there is no call, and no frame, for each.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches):
        doc, own = None, []
        for batch in batches:
            out: list[tuple] = []
            for d, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != doc:
                    out += [(doc, *r) for r in fn(own)]
                    doc, own = d, []
                own.append((a, b))
            if out:
                yield batch_of(out)
        out = [(doc, *r) for r in fn(own)]
        if out:
            yield batch_of(out)

    return edges.select("doc_id", "src", "dst").repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


def distances(refs: DataFrame) -> DataFrame:
    """(doc_id, src, dst, d): shortest distances between different articles of a document, however long: one shuffle."""

    def run(edges):
        after: dict[int, list[int]] = {}
        for a, b in edges:
            after.setdefault(a, []).append(b)
        out = []
        for s in after:
            depth, layer, d = {s: 0}, [s], 0
            while layer:
                d += 1
                layer = [w for w in dict.fromkeys(w for v in layer for w in after.get(v, ())) if w not in depth]
                depth.update(dict.fromkeys(layer, d))
            out += [(s, v, k) for v, k in depth.items() if k]
        return out

    return _by_document(pairs(refs), run, "doc_id bigint, src int, dst int, d int")


def components(vertices: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, v, root): the least vertex that is linked in either direction; cited articles that don't exist link those that cite them."""

    def roots(edges):
        up: dict[int, int] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            up[b] = a
        return [(x, find(x)) for x in list(up)]

    linked = _by_document(pairs(refs), roots, "doc_id bigint, v int, root int")
    return vertices.join(linked, ["doc_id", "v"], "left").select("doc_id", "v", F.coalesce("root", "v").alias("root"))


def chains(refs: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, path): simple paths of 2 to ``most`` edges."""
    e = pairs(refs)
    paths = e.select("doc_id", F.array("src", "dst").alias("p"))
    out = None
    for _ in range(most - 1):
        paths = paths.join(e, (paths["doc_id"] == e["doc_id"]) & (F.element_at(paths["p"], -1) == e["src"])).where(~F.array_contains("p", F.col("dst"))).select(paths["doc_id"], F.concat("p", F.array("dst")).alias("p"))
        out = paths if out is None else out.unionByName(paths)
    return out.select("doc_id", F.array_join("p", "-").alias("path"), F.size("p").alias("n_vertices"))


def cycles(refs: DataFrame) -> DataFrame:
    """(doc_id, cycle, n_vertices): simple cycles of two and more vertices, of any length, each once, from its least vertex.

    Depth-first search within each document from each vertex over greater ones, which turns back where the first can't be reached any more.
    """

    def run(edges):
        after: dict[int, list[int]] = {}
        before: dict[int, list[int]] = {}
        for a, b in sorted(edges):
            after.setdefault(a, []).append(b)
            before.setdefault(b, []).append(a)
        out = []
        for s in sorted(after):
            # what leads back to s over vertices not below it
            back, layer = {s}, [s]
            while layer:
                layer = [w for v in layer for w in before.get(v, ()) if w > s and w not in back and not back.add(w)]
            stack = [(s, (s,))]
            while stack:
                v, path = stack.pop()
                for w in after.get(v, ()):
                    if w == s and len(path) > 1:
                        out.append(("-".join(map(str, path)), len(path)))
                    elif w > s and w in back and w not in path:
                        stack.append((w, (*path, w)))
        return out

    return _by_document(pairs(refs), run, "doc_id bigint, cycle string, n_vertices int")


def betweenness(refs: DataFrame) -> DataFrame:
    """(doc_id, v, betweenness) by Brandes' algorithm within each document."""

    def run(edges):
        out: dict[int, list[int]] = {}
        for a, b in edges:
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
        score = dict.fromkeys(out, 0.0)
        for s in out:
            order, before, count, depth, queue = [], {v: [] for v in out}, dict.fromkeys(out, 0), {s: 0}, [s]
            count[s] = 1
            while queue:
                v = queue.pop(0)
                order.append(v)
                for w in out[v]:
                    if w not in depth:
                        depth[w] = depth[v] + 1
                        queue.append(w)
                    if depth[w] == depth[v] + 1:
                        count[w] += count[v]
                        before[w].append(v)
            share = dict.fromkeys(out, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    share[v] += count[v] / count[w] * (1 + share[w])
                if w != s:
                    score[w] += share[w]
        return [(v, round(x, 6)) for v, x in score.items()]

    return _by_document(pairs(refs), run, "doc_id bigint, v int, betweenness double")
