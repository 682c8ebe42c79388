"""The schema of a graph (G1-G18): extraction, closure, paths, connectivity and checks.

Edges of hierarchies are (child, parent); schema rows are (class, property, range, is_object).
Loops checkpoint each round and stop when nothing new is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, XSD, local_name, namespace
from graphloom.operators import edits
from graphloom.sizes import cut

#: Namespaces of the language itself.
BUILT_IN = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#")


def extract_schema(g: DataFrame) -> DataFrame:
    """G1: (class, property, range, is_object) of every typed subject; untyped literals are strings."""
    types = g.where(F.col("p") == RDF_TYPE).where(
        ~F.array_contains(F.array(*map(F.lit, BUILT_IN)), namespace(F.col("o")))
    ).select("s", F.col("o").alias("class")).distinct()
    facts = g.where(F.col("p") != RDF_TYPE)
    literals = facts.where("o_kind = 'literal'").select(
        "s", F.col("p").alias("property"), F.coalesce("o_datatype", F.lit(XSD + "string")).alias("range"), F.lit(False).alias("is_object")
    )
    objects = facts.where("o_kind = 'iri'").select("s", F.col("p").alias("property"), "o").join(
        types.select(F.col("s").alias("o"), F.col("class").alias("range")), "o"
    )
    objects = objects.select("s", "property", "range", F.lit(True).alias("is_object"))
    # one row a subject and property shape before the classes are joined
    return types.join(literals.unionByName(objects).distinct(), "s").select("class", "property", "range", "is_object").distinct()


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth), shortest depth, until nothing new is found or to ``max_depth``; cycles end."""
    step = edges.select("child", "parent").where("child <> parent").distinct()
    found = front = cut(step.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    depth = 1
    while not front.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        up = front.join(step.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select(
            "child", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")
        )
        front = cut(up.where("child <> ancestor").distinct().join(found, ["child", "ancestor"], "left_anti"))
        found = cut(found.unionByName(front))
    return found


def lift_schema(schema: DataFrame, edges: DataFrame) -> DataFrame:
    """For classes without own rows, the properties of their subclasses; a range goes up to a direct parent with at least two present subclasses, at any depth.

    Of several such parents the range takes the smallest name.
    """
    present = schema.select("class").distinct()
    above = closure(edges)
    below = above.select(F.col("ancestor").alias("parent"), "child").where("parent <> child").join(
        present.withColumnRenamed("class", "child"), "child"
    )
    lifted = below.groupBy("parent").agg(F.count_distinct("child").alias("n")).where("n >= 2").select("parent")
    parent_of = edges.join(lifted, "parent").groupBy(F.col("child").alias("range")).agg(F.min("parent").alias("up"))
    up = above.select(F.col("child").alias("class"), "ancestor").join(schema, "class").join(parent_of, "range", "left")
    up = up.select(F.col("ancestor").alias("class"), "property", F.coalesce("up", "range").alias("range"), "is_object").distinct()
    return up.join(present, "class", "left_anti")


def schema_views(schema: DataFrame) -> DataFrame:
    """Per property its domains, ranges and kind."""
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("class", "domains"), ("range", "ranges"))]
    return schema.groupBy("property").agg(*sets, F.bool_or("is_object").alias("is_object"))


def merge_schemas(schemas: list[DataFrame]) -> DataFrame:
    """All rows, with each property's range in the last schema that has it."""
    tagged = [s.withColumn("order", F.lit(i)) for i, s in enumerate(schemas)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    last = rows.groupBy("property").agg(F.max(F.struct("order", "range")).getField("range").alias("global_range"))
    return rows.drop("order").distinct().join(last, "property")


def class_properties(schema: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Own and inherited properties."""
    inherited = ancestors.select(
        F.col("child").alias("c"), F.col("ancestor").alias("class")
    ).join(schema, "class").select(F.col("c").alias("class"), "property", "range")
    return schema.select("class", "property", "range").unionByName(inherited).distinct()


def elements(schema: DataFrame) -> DataFrame:
    """Cards of classes and properties with their links; a class is referenced in the models of the classes that have it as a range."""
    sets = lambda c: F.array_sort(F.collect_set(c))
    props = schema.groupBy(F.col("property").alias("element")).agg(
        sets("class").alias("defined_in"), sets(F.when(F.col("is_object"), F.col("range"))).alias("connects_to")
    )
    out = schema.where("is_object").groupBy(F.col("range").alias("element")).agg(
        sets("class").alias("connected_from"), sets("class").alias("referenced_in")
    )
    classes = schema.groupBy(F.col("class").alias("element")).agg(
        sets("property").alias("properties"), sets(F.when(F.col("is_object"), F.col("range"))).alias("connects_to")
    )
    return classes.join(out, "element", "full").withColumn("type", F.lit("class")).unionByName(
        props.withColumn("type", F.lit("property")), allowMissingColumns=True
    )


def connection_graph(schema: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, via, reverse) by object properties and subclass edges, both ways."""
    ways = schema.where("is_object").select(F.col("class").alias("a"), F.col("range").alias("b"), F.col("property").alias("via"))
    ways = ways.unionByName(
        edges.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit("subClassOf").alias("via"))
    ).distinct()
    back = ways.select(F.col("b").alias("a"), F.col("a").alias("b"), "via", F.lit(True).alias("reverse"))
    return ways.withColumn("reverse", F.lit(False)).unionByName(back)


def shortest_paths(graph: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """(a, b, hops, path) for each pair; of equally short ones the smallest path."""
    step = graph.select(F.col("a").alias("at"), F.col("b").alias("to")).where("at <> to").distinct()
    start = pairs.select("a").distinct().select("a", F.col("a").alias("at"), F.lit(0).alias("hops"), F.array("a").alias("path"))
    found = front = cut(start)
    for hop in range(1, max_hops + 1):
        nxt = front.join(step, "at").select(
            "a", F.col("to").alias("at"), F.lit(hop).alias("hops"), F.concat("path", F.array("to")).alias("path")
        )
        front = cut(nxt.groupBy("a", "at", "hops").agg(F.min("path").alias("path")).join(found, ["a", "at"], "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    return pairs.join(found.withColumnRenamed("at", "b"), ["a", "b"])


def path_through(graph: DataFrame, classes: list[str], max_hops: int = 6) -> DataFrame:
    """Paths between neighbours of a list of classes; if none is connected, that of the first connected pair of any two."""
    spark, n = graph.sparkSession, len(classes)
    pairs = [(i * n + j, classes[i], classes[j]) for i in range(n) for j in range(i + 1, n)]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, hops int, path array<string>")
    asked = spark.createDataFrame([(*p, p[0] % n == p[0] // n + 1) for p in pairs], "turn int, a string, b string, neighbours boolean")
    found = cut(shortest_paths(graph, asked, max_hops))
    near = found.where("neighbours")
    if near.isEmpty():
        near = found.orderBy("turn").limit(1)
    return near.select("a", "b", "hops", "path")


#: Edges, in both directions, of one part of a graph.
PART_EDGES = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by the smallest label that reaches a node along (a, b)."""
    conf, name = edges.sparkSession.conf, "spark.sql.shuffle.partitions"
    raw, usual = cut(edges.select("a", "b")), conf.get("spark.sql.shuffle.partitions")
    # parts grow in number with the edges, not in size; repeated edges are dealt before they are told apart, so no task gathers those of its input
    parts = max(int(usual), -(-2 * raw.count() // PART_EDGES))
    conf.set(name, str(parts))
    try:
        both = raw.unionByName(raw.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
        both = cut(both.repartition(parts, "a", "b").distinct())
        nodes = raw.select(F.explode(F.array("a", "b")).alias("node")).repartition(parts, "node")
        labels = cut(nodes.distinct().withColumn("component", F.col("node")))
        while True:
            near = both.join(
                labels.select(F.col("node").alias("b"), "component"), "b"
            ).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
            new = labels.join(near, "node", "left").withColumn("low", F.least("component", F.coalesce("near", "component")))
            # the label's own label is a shortcut
            jump = new.select("node", F.col("low").alias("hop"), "component").join(
                new.select(F.col("node").alias("hop"), F.col("low").alias("far")), "hop", "left"
            )
            nxt = cut(jump.select("node", F.least("hop", F.coalesce("far", "hop")).alias("new"), "component"))
            if nxt.where("new <> component").isEmpty():
                return labels
            labels = nxt.select("node", F.col("new").alias("component"))
    finally:
        conf.set(name, usual)


def check_connected(edges: DataFrame) -> DataFrame:
    """Number of components, and whether that is acceptable: one, or two with disjoint namespaces."""
    named = components(edges).withColumn("ns", namespace(F.col("node")))
    spread = named.groupBy("ns").agg(F.count_distinct("component").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("spread"))
    n = named.agg(F.count_distinct("component").alias("n_components"))
    return n.join(F.broadcast(spread)).select(
        "n_components", ((F.col("n_components") <= 1) | ((F.col("n_components") == 2) & (F.col("spread") <= 1))).alias("accepted")
    )


def infer_types(patterns: DataFrame, schema: DataFrame) -> DataFrame:
    """(variable, class) by explicit types, domains and ranges of the patterns (s, p, o)."""
    explicit = patterns.where(F.col("p") == RDF_TYPE).select(
        F.col("s").alias("variable"), F.col("o").alias("class"), F.lit("type").alias("reason")
    )
    uses = patterns.where(F.col("p") != RDF_TYPE).join(schema.withColumnRenamed("property", "p"), "p")
    domain = uses.select(F.col("s").alias("variable"), "class", F.lit("domain").alias("reason"))
    ranged = uses.where("is_object").select(F.col("o").alias("variable"), F.col("range").alias("class"), F.lit("range").alias("reason"))
    return explicit.unionByName(domain).unionByName(ranged).where(F.col("variable").startswith("?")).distinct()


def validate(patterns: DataFrame, schema: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(s, p, o, issue, severity) of patterns.

    Errors: unknown properties and classes; a property that no class of a typed subject has, or inherits. Warnings: the same
    seen from the property's domains; an object whose types, a literal or a resource don't fit the property's range.
    """
    facts = patterns.where(F.col("p") != RDF_TYPE)
    typed = patterns.where(F.col("p") == RDF_TYPE)
    known = schema.select(F.col("property").alias("p")).distinct()
    classes = schema.select(F.col("class").alias("o")).union(ancestors.select("ancestor")).distinct()
    types = typed.select(F.col("s").alias("v"), F.col("o").alias("t")).distinct()
    # a type is itself and all that is above it
    fits = types.select("v", F.col("t").alias("fit")).union(
        types.join(ancestors.select(F.col("child").alias("t"), "ancestor"), "t").select("v", "ancestor")
    ).distinct()
    uses = facts.where(F.col("s").startswith("?")).join(types.select(F.col("v").alias("s")).distinct(), "s", "left_semi")
    having = uses.join(
        schema.select(F.col("property").alias("p"), F.col("class").alias("fit")).distinct(), "p"
    ).join(fits.withColumnRenamed("v", "s"), ["s", "fit"]).select("s", "p", "o").distinct()
    without = uses.join(having, ["s", "p", "o"], "left_anti")
    ranged = facts.join(schema.select(F.col("property").alias("p"), "range", "is_object").distinct(), "p")
    resource = F.col("o").startswith("http")
    literal = ranged.where(~F.col("o").startswith("?") & ~resource)
    of_type = ranged.where(F.col("o").startswith("?")).join(types.select(F.col("v").alias("o")).distinct(), "o", "left_semi")
    good = literal.where("not is_object").select("s", "p", "o").union(
        of_type.where("is_object").join(
            fits.select(F.col("v").alias("o"), F.col("fit").alias("range")), ["o", "range"], "left_semi"
        ).select("s", "p", "o")
    ).distinct()
    unfit = literal.unionByName(of_type).select("s", "p", "o").distinct().join(good, ["s", "p", "o"], "left_anti")
    parts = [
        (facts.join(known, "p", "left_anti"), "unknown property", "error"),
        (typed.where(~F.col("o").startswith("?")).join(classes, "o", "left_anti"), "unknown class", "error"),
        (without, "class property mismatch", "error"),
        (without.join(known, "p", "left_semi"), "domain mismatch", "warning"),
        (unfit, "range mismatch", "warning"),
    ]
    return reduce(
        DataFrame.unionByName,
        (df.select("s", "p", "o", F.lit(issue).alias("issue"), F.lit(severity).alias("severity")) for df, issue, severity in parts)
    )


def suggest(terms: DataFrame, known: DataFrame, most: int = 5, n: int = 3) -> DataFrame:
    """For each unknown term the n nearest known local names within an edit distance."""
    a = terms.select("term", F.lower(local_name(F.col("term"))).alias("x"))
    b = known.select(F.col("term").alias("suggestion"), F.lower(local_name(F.col("term"))).alias("y"))
    near = edits.within(a, b, "x", "y", most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("distance", "suggestion")))
    return ranked.where(F.col("rank") <= n).select("term", "suggestion", "distance", "rank")


def property_kind(schema: DataFrame) -> DataFrame:
    """Which kinds of properties each class has."""
    data, obj = F.bool_or(~F.col("is_object")), F.bool_or("is_object")
    return schema.groupBy("class").agg(
        F.when(data & obj, "both").when(obj, "only_object").when(data, "only_datatype").otherwise("none").alias("kind")
    )


def pattern_facts(patterns: DataFrame) -> DataFrame:
    """Per query the patterns, variables and type constraints; columns query_id, s, p, o."""
    terms = F.filter(F.array("s", "p", "o"), lambda x: x.startswith("?"))
    facts = patterns.withColumn("v", F.explode_outer(terms))
    variables = facts.groupBy("query_id").agg(F.count_distinct("v").alias("n_variables"))
    rest = patterns.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_patterns"), F.count_if(F.col("p") == RDF_TYPE).alias("n_types"))
    return rest.join(variables, "query_id")


def variable_positions(patterns: DataFrame) -> DataFrame:
    """(query_id, variable, positions, classes): where each variable stands, and the classes it is constrained to.

    patterns (query_id, pattern_id, s, p, o); a position is its pattern's number and subject, predicate or object, in order.
    """
    places = F.array(
        *(F.struct(F.col(c).alias("variable"), F.lit(i).alias("i"), F.lit(n).alias("place")) for i, (c, n) in enumerate((("s", "subject"), ("p", "predicate"), ("o", "object"))))
    )
    each = patterns.select("query_id", "pattern_id", F.explode(places).alias("x"), "p", "o").where(F.col("x.variable").startswith("?"))
    cls = F.when((F.col("p") == RDF_TYPE) & (F.col("x.place") == "subject") & ~F.col("o").startswith("?"), F.col("o"))
    ordered = F.array_sort(F.collect_list(F.struct("pattern_id", "x.i", "x.place")))
    names = F.transform(ordered, lambda x: F.concat(F.lit("pattern_"), x["pattern_id"].cast("string"), F.lit("_"), x["place"]))
    return each.groupBy("query_id", F.col("x.variable").alias("variable")).agg(
        names.alias("positions"), F.array_sort(F.collect_set(cls)).alias("classes")
    )


def class_card(schema: DataFrame, edges: DataFrame, cls: str) -> DataFrame:
    """One class with its properties, parents and children."""
    props = schema.where(F.col("class") == cls).groupBy("class").agg(
        F.array_sort(F.collect_set(F.struct("property", "range"))).alias("properties")
    )
    parents = edges.where(F.col("child") == cls).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    children = edges.where(F.col("parent") == cls).agg(F.array_sort(F.collect_set("child")).alias("children"))
    return props.join(F.broadcast(parents)).join(F.broadcast(children))


def list_classes(schema: DataFrame) -> DataFrame:
    """All classes with their numbers of properties and of links to others."""
    return schema.groupBy("class").agg(
        F.count_distinct("property").alias("n_properties"),
        F.count_distinct(F.when(F.col("is_object"), F.struct("property", "range"))).alias("n_links")
    )


def model_rows(schema: DataFrame, cls: str) -> DataFrame:
    """One class's model as rows."""
    return schema.where(F.col("class") == cls).select("class", "property", "range", "is_object").distinct()


def filter_schema(schema: DataFrame, keep: DataFrame, instances: DataFrame, n: int = 3) -> DataFrame:
    """Rows of kept (class, property) with up to n sample values of ``instances`` (class, property, value)."""
    ranked = instances.distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("class", "property").orderBy("value"))
    ).where(F.col("r") <= n)
    samples = ranked.groupBy("class", "property").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return schema.join(keep, ["class", "property"], "left_semi").join(samples, ["class", "property"], "left")
