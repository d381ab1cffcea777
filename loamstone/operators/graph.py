"""A typed memory graph as two tables: ingestion, visibility, spreading activation, entity merge and Hebbian updates.

nodes: id, kind, and the columns of their kind; owners array<string>, character_scoped and internal for visibility.
edges: id, kind, src, dst, weight and signed attributes. Symmetric kinds are walked both ways.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..session import released, saved

SYMMETRIC = ("transition", "co_occurrence", "chat")
GAIN, HOPS, HOP_DECAY, FIRE, STEP = 0.35, 2, 0.6, 0.15, 0.05


def walks(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges as they are walked: directed, and symmetric ones both ways (a symmetric self-loop twice); with ``nodes``, both ends must be there."""
    back = edges.where(F.col("kind").isin(*SYMMETRIC)).withColumns({"src": F.col("dst"), "dst": F.col("src")})
    out = edges.unionByName(back)
    if nodes is not None:
        ids = nodes.select("id")
        out = out.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out


def neighbours(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(id, neighbour, edge) over every incident edge whichever its direction, without self-loops, each edge once per node."""
    e = edges.where("src <> dst")
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.col("id").alias("edge")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.col("id").alias("edge")))
    return both.join(node_ids.select("id"), "id", "left_semi").dropDuplicates(["id", "edge"])


def visible(nodes: DataFrame, viewers: list[str] | None) -> DataFrame:
    """All nodes without viewers; else those scoped to the character or owned by a viewer. Nodes without owners are hidden from viewers."""
    if not viewers:
        return nodes
    return nodes.where(F.col("character_scoped") | F.coalesce(F.arrays_overlap("owners", F.array(*map(F.lit, viewers))), F.lit(False)))


def public(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("internal"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree) inside ``nodes``; a self-loop counts 2."""
    ids = nodes.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = inner.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return ids.join(ends, "id", "left").fillna({"degree": 0})


def weighted_walks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, strength) of walks (src, dst, strength) between nodes (id, strength): the edge's strength times that of the node it reaches."""
    return _reaching(edges, nodes).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")


def _reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``weighted_walks`` of walks that all start at nodes."""
    reached = nodes.select(F.col("id").alias("dst"), F.col("strength").alias("_own"))
    return edges.join(reached, "dst").select("src", "dst", (F.col("strength") * F.col("_own")).alias("strength"))


def spread(walks_: DataFrame, seeds: DataFrame, *, gain: float = GAIN, hops: int = HOPS, hop_decay: float = HOP_DECAY, floor: float = 0.0, per: list[str] | None = None, cliques: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(per.., id, activation): the seeds' own mass, ``floor`` at least, and what nodes receive over the hops. walks_: (src, dst, strength); seeds: (per.., id, activation).

    Each hop passes the mass received in the hop before (the seeds' at first) to neighbours, times the strength, over the number of walks out of the node; only positive mass
    passes. All groups of ``per`` spread in one plan, with two joins and one sum per hop: walks, their numbers and the mass of each hop are tables, read as often as they are needed.

    ``cliques`` (group, id, strength, sign) stand for walks between all pairs of a group's members without a row for each: a member gets the group's sum less its own share, times its
    strength. Signed groups add up to each pair once where groups overlap (``shared_cliques``).

    With ``nodes`` (id, strength) the walks are those of ``weighted_walks``: each hop looks up what leads out of the nodes that it starts from, and only that is joined and written.
    """
    keys = per or []
    members = shared = None
    if nodes is None:
        walks_ = saved(walks_)
        fans = walks_.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan"))
    if cliques is not None:
        sizes = saved(cliques.groupBy("group").agg(F.count("*").alias("size")))  # a table of its own: a hot group can be split in the join back
        members = cliques.join(sizes, "group")
        shared = members.groupBy("id").agg(F.sum(F.col("sign") * (F.col("size") - 1)).alias("fan"))
        shared = saved(shared) if nodes is not None else shared
        members = saved(members.where("size > 1").select("group", "id", "strength", "sign"))
    every = lambda own: own if shared is None else own.unionByName(shared).groupBy("id").agg(F.sum("fan").alias("fan"))
    if nodes is None:
        fans = saved(every(fans).where("fan > 0"))
    fronts = [saved(seeds.select(*keys, F.col("id").alias("src"), F.greatest(F.lit(floor), F.col("activation")).alias("mass")))]
    for hop in range(max(1, hops)):
        front, rate = fronts[-1].where("mass > 0"), gain * hop_decay**hop
        if hop == 0:
            front = front.groupBy(*keys, "src").agg(F.sum("mass").alias("mass"))
        if nodes is not None:
            led = walks_.join(saved(front.select("src").distinct()), "src", "left_semi")
            ways = saved(weighted_walks(led, nodes) if hop == 0 else _reaching(led, nodes))  # later fronts are nodes anyway
            fans = every(ways.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan"))).where("fan > 0")
        else:
            ways = walks_
        unit = front.join(fans.withColumnRenamed("id", "src"), "src").select(*keys, F.col("src").alias("id"), (rate * F.col("mass") / F.col("fan")).alias("unit"))
        passed = unit.withColumnRenamed("id", "src").join(ways, "src").select(*keys, F.col("dst").alias("src"), (F.col("unit") * F.col("strength")).alias("mass")).where("mass > 0")
        if members is not None:
            own = unit.join(members, "id")
            sums = saved(own.groupBy(*keys, "group").agg(F.sum("unit").alias("sum")))
            gained = sums.join(members, "group").select(*keys, F.col("id").alias("src"), (F.col("sign") * F.col("strength") * F.col("sum")).alias("mass"))
            itself = own.select(*keys, F.col("id").alias("src"), (-F.col("sign") * F.col("strength") * F.col("unit")).alias("mass"))
            passed = passed.unionByName(gained).unionByName(itself)
        whole = passed.groupBy(*keys, "src").agg(F.sum("mass").alias("mass"), F.sum(F.abs("mass")).alias("_size"))
        fronts.append(saved(whole.where("mass > 1e-12 * _size").drop("_size")))  # what groups' signs leave of a sum that is zero is none
    total = reduce(DataFrame.unionByName, fronts)
    return total.groupBy(*keys, F.col("src").alias("id")).agg(F.sum("mass").alias("activation"))


def chat_cliques(nodes: DataFrame, weight: float = 0.1) -> DataFrame:
    """The cliques of ``chat_edges`` for ``spread``, a row for each fact and episode (id, kind, chat_id, strength) of a chat: its strength times that of an edge."""
    own = nodes.where(F.col("kind").isin("fact", "episode") & F.col("chat_id").isNotNull())
    edge = S.edge_strength(F.lit("chat"), F.lit(weight))
    return own.select(F.col("chat_id").cast("string").alias("group"), "id", (edge * F.col("strength")).alias("strength"), F.lit(1).alias("sign"))


#: different participants of a node up to which its cliques are folded: 2 ** n - 1 groups each
MOST_SHARED = 10


def shared_cliques(members: DataFrame, weight: float = 0.15) -> DataFrame:
    """The cliques of nodes that share a participant, each pair once, for ``spread``. members: (id, participants array, strength).

    A pair that shares k participants is in k groups, k (k - 1) / 2 pairs of participants and so on; with alternating signs they add up to one. A node with more than
    MOST_SHARED participants is an error: write its edges with ``shared_pairs``.
    """
    edge = S.edge_strength(F.lit("co_occurrence"), F.lit(weight))
    some = F.array_sort(F.array_distinct(F.filter("participants", lambda x: x.isNotNull())))
    own = members.select("id", some.alias("of"), (edge * F.col("strength")).alias("strength"))
    own = own.withColumn("of", F.when(F.size("of") > MOST_SHARED, F.raise_error(F.concat(F.lit("too many participants of "), F.col("id").cast("string"))).cast("array<string>")).otherwise(F.col("of").cast("array<string>")))
    out = own.where(F.size("of") > 0).withColumn("bits", F.explode(F.expr("sequence(1, cast(pow(2, size(of)) as int) - 1)")))
    out = out.withColumn("part", F.expr("filter(of, (x, i) -> (bits div cast(pow(2, i) as int)) % 2 = 1)"))
    return out.select(F.array_join("part", "\x1f").alias("group"), "id", "strength", F.when(F.size("part") % 2 == 1, 1).otherwise(-1).alias("sign"))


def spread_for_members(walks_: DataFrame, seeds: DataFrame, members: DataFrame, *, group: str = "group", gain: float = GAIN, hops: int = HOPS, hop_decay: float = HOP_DECAY, cliques: DataFrame | None = None) -> DataFrame:
    """(group, member, id, activation): what each member of each group would get from spreading the group's seeds (group, id, activation) and its own bias together.

    members: (group, member, id, activation), the node and the bias of a member. Spreading is linear as long as all mass is positive: the seeds of a group spread once, each node that
    any member biases spreads once with mass 1, and both are added by weight, however many groups ask. A negative seed, bias or strength is an error.
    """
    bad = seeds.where("activation < 0").select(F.lit(1).alias("x")).unionByName(members.where("activation < 0").select(F.lit(1).alias("x"))).unionByName(walks_.where("strength < 0").select(F.lit(1).alias("x")))
    if not bad.isEmpty():
        raise ValueError("spreading is linear over masses and strengths that are not negative only")
    how = {"gain": gain, "hops": hops, "hop_decay": hop_decay, "cliques": cliques}
    shared = spread(walks_, seeds.select(group, "id", "activation"), per=[group], **how)
    units = spread(walks_, members.select("id").distinct().select(F.col("id").alias("_node"), "id", F.lit(1.0).alias("activation")), per=["_node"], **how)
    own = members.select(group, "member", F.col("id").alias("_node"), F.col("activation").alias("_bias")).join(units, "_node").select(group, "member", "id", (F.col("_bias") * F.col("activation")).alias("activation"))
    every = shared.join(members.select(group, "member").distinct(), group).select(group, "member", "id", "activation").unionByName(own)
    return every.groupBy(group, "member", "id").agg(F.sum("activation").alias("activation"))


def combined(nodes: DataFrame, activation: DataFrame, *, base_weight: float = 1.0, spread_weight: float = 1.2, mood: Column | None = None, per: list[str] | None = None) -> DataFrame:
    """Nodes (id, base_level, ..) with score = base_weight * base_level + spread_weight * activation; positive scores grow with the likeness to the mood.

    Nodes without activation have their base level alone (with ``per``, activated nodes only).
    """
    out = nodes.join(activation.select(*(per or []), "id", "activation"), "id", "inner" if per else "left").fillna({"activation": 0.0})
    score = base_weight * F.col("base_level") + spread_weight * F.col("activation")
    if mood is not None:
        score = F.when(score > 0, score * (1 + mood)).otherwise(score)
    return out.withColumn("score", score)


def person_bias(persons: DataFrame, viewers: list[str], seed: float = 0.8, share: float = 0.6) -> DataFrame:
    """(id, activation): the node of each viewer, by its user id or else by the id person:user, gets a share of the seed of the self."""
    found = persons.where(F.col("user_id").isin(viewers) | F.col("id").isin([f"person:{v}" for v in viewers])) if viewers else persons.limit(0)
    who = F.coalesce("user_id", F.regexp_replace("id", "^person:", ""))
    own = F.struct(F.col("user_id").isNull(), F.col("id"))  # of several nodes of a viewer the one that names the user
    return found.groupBy(who.alias("_who")).agg(F.min_by("id", own).alias("id")).select("id", F.lit(seed * share).alias("activation"))


def activation_trace(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, viewers: list[str] | None = None, private: bool = False, include_internal: bool = False, mood: Column | None = None, hops: int = HOPS) -> DataFrame:
    """(id, base_level, seed, activation, score) of the visible nodes for the seeds (id, activation) of one query.

    nodes: id, strength, base_level, user_id, owners, character_scoped, internal. edges: as walked, with their strength. The viewers' own nodes get a bias.
    ``private`` spreads inside what the viewers may see, otherwise the whole graph takes part and only the result is filtered.
    """
    inner = visible(nodes, viewers) if private else nodes
    own = seeds.select("id", "activation").unionByName(person_bias(nodes, viewers or []))
    own = own.join(inner.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("activation").alias("activation"))
    scores = combined(inner, spread(edges, own, hops=hops, nodes=inner), mood=mood)
    shown = visible(scores, viewers) if include_internal else public(visible(scores, viewers))
    return shown.join(own.select("id", F.col("activation").alias("seed")), "id", "left").fillna({"seed": 0.0}).select("id", "base_level", "seed", "activation", "score")


def retrieved(trace: DataFrame, texts: DataFrame, *, least: float = FIRE, budget: int = 1_000, tokens: Column | None = None) -> DataFrame:
    """(id, text, score, position, used_tokens): nodes by score, then by id, both descending, as long as their lines ``- text`` fit the budget of tokens."""
    line = F.concat(F.lit("- "), F.coalesce("text", F.lit("")))
    cost = T.token_count(line) if tokens is None else tokens
    items = trace.where(F.col("score") >= least).join(texts.select("id", "text"), "id").withColumn("_tokens", cost)
    items = items.where("_tokens >= 0").orderBy(F.desc("score"), F.desc("id")).limit(max(0, budget))  # a line has a token at least, so no more than ``budget`` rows can fit
    order = Window.orderBy(F.desc("score"), F.desc("id"))
    out = items.withColumn("used_tokens", F.sum("_tokens").over(order)).withColumn("position", F.row_number().over(order))
    return out.where(F.col("used_tokens") <= budget).select("id", "text", "score", "position", "used_tokens")


def overview(nodes: DataFrame, edges: DataFrame, viewers: list[str] | None = None, include_internal: bool = False) -> DataFrame:
    """(what, kind, n): visible nodes by kind, edges by kind with both ends visible, and known users."""
    seen = visible(nodes, viewers) if include_internal else public(visible(nodes, viewers))
    ids = seen.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    of = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    users = seen.agg(F.count_distinct("user_id").alias("n")).select(F.lit("users").alias("what"), F.lit(None).cast("string").alias("kind"), "n")
    return of(seen, "nodes").unionByName(of(inner, "edges")).unionByName(users)


def scoped(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Nodes with owners added and the character's flag set, after marks (id, user_id; null: the character)."""
    none = F.array().cast("array<string>")
    per = marks.groupBy("id").agg(F.array_sort(F.collect_set("user_id")).alias("_users"), F.max(F.col("user_id").isNull()).alias("_all"))
    out = nodes.join(per, "id", "left").withColumns({
        "owners": F.array_union(F.coalesce("owners", none), F.coalesce("_users", none)),
        "character_scoped": F.col("character_scoped") | F.coalesce("_all", F.lit(False)),
    })
    return out.select(nodes.columns)


def by_external_ref(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, id): the node that carries a reference; of several the least id."""
    own = nodes.select("id", F.explode("external_refs").alias("ref"))
    return own.join(refs.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.min("id").alias("id"))


def temporal_intervals(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, start, end) of nodes: an episode's own time, else the interval of the row named by its source (source, start, end); null where there is none."""
    s = sources.select("source", F.col("start").alias("_s"), F.col("end").alias("_e"))
    own = F.when(F.col("kind") == "episode", F.col("timestamp"))
    return nodes.join(s, "source", "left").select("id", F.coalesce(own, "_s").alias("start"), F.when(own.isNull(), F.col("_e")).alias("end"))


def node_text(kind: Column, text: Column, name: Column, source: Column, content: Column, kind_label: Column) -> Column:
    """How a node reads, by its kind and the prefix of its source."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    head = lambda label, body: F.concat(F.lit("["), label, F.lit("] "), body)
    return (
        F.when(source.startswith("wiki"), head(F.lit("wiki"), F.coalesce(blank(content), blank(text), F.lit(""))))
        .when(kind == "person", F.concat_ws(": ", blank(name), blank(text)))
        .when(kind == "fact", head(F.coalesce(blank(kind_label), F.lit("fact")), F.coalesce(blank(content), blank(text), F.lit(""))))
        .when(kind == "episode", head(F.lit("episode"), F.coalesce(blank(text), F.lit(""))))
        .otherwise(F.coalesce(blank(text), blank(name), F.lit("")))
    )


def text_chunks(nodes: DataFrame) -> DataFrame:
    """(id, text): what of a graph is indexed: trimmed texts that are not blank, without the self."""
    return nodes.where(F.col("id") != "self").select("id", F.trim("text").alias("text")).where("text <> ''")


def summaries_graph(profiles: DataFrame) -> DataFrame:
    """A person's node for each profile (user_id, name, aliases, summary)."""
    name = F.coalesce(F.nullif(F.trim(F.coalesce("name", F.lit(""))), F.lit("")), F.col("user_id"))
    return profiles.select(F.concat(F.lit("person:"), "user_id").alias("id"), F.lit("person").alias("kind"), F.col("summary").alias("text"), name.alias("name"), "aliases", "user_id", F.array("user_id").alias("owners"))


def emotion_graph(emotions: DataFrame) -> DataFrame:
    """Edges from the self to persons, by the size of the relation (user_id, dims)."""
    person = F.concat(F.lit("person:"), "user_id")
    return emotions.select(S.edge_id(F.lit("relation"), F.lit("self"), person).alias("id"), F.lit("relation").alias("kind"), F.lit("self").alias("src"), person.alias("dst"), relation_edge_weight(F.col("dims")).alias("weight"))


def chat_edges(nodes: DataFrame, weight: float = 0.1) -> DataFrame:
    """Edges between all facts and episodes of one chat, each pair once; a row per pair is the result itself."""
    own = nodes.where(F.col("kind").isin("fact", "episode") & F.col("chat_id").isNotNull())
    return pair_edges(shared_pairs(own.select("id", "chat_id"), "id", "chat_id"), "chat", weight)


def wiki_graph(sections: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a fact of the self for each section (section, title, text); the wiki projection of before goes first."""
    nodes, edges = removed(nodes, edges, stale(nodes, "wiki:", nodes.limit(0)))
    id_ = F.concat(F.lit("fact:wiki:"), F.col("section").cast("string"))
    own = sections.where(F.trim("text") != "").select(id_.alias("id"), F.lit("fact").alias("kind"), F.concat_ws(": ", F.nullif(F.trim("title"), F.lit("")), F.trim("text")).alias("text"), F.concat(F.lit("wiki:"), F.col("section").cast("string")).alias("source"))
    new = own.select(S.edge_id(F.lit("fact"), F.lit("self"), F.col("id")).alias("id"), F.lit("fact").alias("kind"), F.lit("self").alias("src"), F.col("id").alias("dst"), F.lit(0.5).alias("weight"))
    return nodes.unionByName(own, allowMissingColumns=True), edges.unionByName(new, allowMissingColumns=True)


def without_wiki(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without what a wiki projected: facts and episodes whose source is a wiki's with their edges, relations of its provenance, references to it, and persons and entities
    that nothing else holds: no owners, no source, no other references. Shared ones stay."""
    none = F.array().cast("array<string>")
    refs = F.filter(F.coalesce("external_refs", none), lambda x: ~x.startswith("wiki:"))
    own = nodes.withColumn("_refs", refs)
    projected = F.col("kind").isin("fact", "episode") & F.coalesce(F.col("source"), F.lit("")).startswith("wiki:")
    alone = (F.size(F.coalesce("owners", none)) == 0) & (F.coalesce("source", F.lit("")) == "") & (F.size("_refs") == 0)
    canonical = F.col("kind").isin("person", "entity") & (F.size(F.coalesce("external_refs", none)) > F.size("_refs"))
    gone = own.where(projected | (canonical & alone)).select("id")
    left = edges.where(~((F.col("kind") == "relation") & F.coalesce(F.col("provenance") == "wiki", F.lit(False)))) if "provenance" in edges.columns else edges
    kept, rest = removed(own, left, gone)
    return kept.withColumn("external_refs", F.when(F.col("kind").isin("person", "entity") & F.col("external_refs").isNotNull(), F.col("_refs")).otherwise(F.col("external_refs"))).select(nodes.columns), rest


def refreshed(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes whose source names a changed row (source, text, importance) with its text and importance; telemetry and owners stay."""
    r = rows.select("source", F.col("text").alias("_t"), F.col("importance").alias("_i"), F.lit(True).alias("_hit"))
    out = nodes.join(r, "source", "left").withColumns({"text": F.when(F.col("_hit"), F.col("_t")).otherwise(F.col("text")), "importance": F.when(F.col("_hit"), F.col("_i")).otherwise(F.col("importance"))})
    return out.select(nodes.columns)


def deduplicated(nodes: DataFrame, edges: DataFrame, report: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a report (source, action): nodes of removed sources go with their edges, those of merged ones are read again from ``rows``."""
    gone = nodes.join(report.where("action = 'removed'").select("source"), "source", "left_semi").select("id")
    left, kept = removed(nodes, edges, gone)
    return refreshed(left, rows.join(report.where("action = 'merged'").select("source"), "source", "left_semi")), kept


def unchanged_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source): projections whose version and fingerprint are those of the last run, so that they need no work."""
    return after.join(before, ["source", "version", "fingerprint"], "left_semi").select("source")


def recalled_group(items: DataFrame) -> DataFrame:
    """(recall, id, activation): a group's recalled nodes (recall, participant, id, activation), each once, for one touch and one Hebbian step."""
    return items.groupBy("recall", "id").agg(F.max("activation").alias("activation"))


def merged_graph(projections: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of projections (nodes, edges), in order: of nodes with one id the first gives the columns, owners and references join; edges merge by id."""
    order = [(n.withColumn("_at", F.lit(k)), e) for k, (n, e) in enumerate(projections)]
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [n for n, _ in order])
    lists = [c for c in ("owners", "external_refs", "aliases") if c in nodes.columns]
    rest = [c for c in nodes.columns if c not in ("id", "_at", *lists)]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in rest]
    joined = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [e for _, e in order])
    return nodes.groupBy("id").agg(*first, *joined), merged_edges(edges)


#: what projects the rows of a source into the graph, by name: DataFrame -> (nodes, edges)
PROJECTORS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {"profiles": lambda rows: (summaries_graph(rows), summaries_graph(rows).select("id", "kind", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")).limit(0))}


def register_projector(name: str, projector: Callable[[DataFrame], tuple[DataFrame, DataFrame]], replace: bool = False) -> None:
    if name in PROJECTORS and not replace:
        raise ValueError(f"a projector named {name} is there already")
    PROJECTORS[name] = projector


def projected(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The graph of several sources, each by the projector of its name."""
    return merged_graph([PROJECTORS[name](rows) for name, rows in sources.items()])


#: nodes of a view that are tried at once, for each node that is still to be taken
TRIED = 8


def grown_view(activation: DataFrame, edges: DataFrame, limit: int, share: float = 1 / 3, retrieved: DataFrame | None = None, grow: bool = True) -> DataFrame:
    """(id, activation, activation_norm, seed, retrieved, position): a connected view of at most ``limit`` of the nodes (id, activation), one row each.

    The ``retrieved`` (id) and the most active share of the limit are its seeds. Then, one after another, that neighbour of the view comes that has the most walks into it, as it has
    grown so far; ties by activation, then the least id. A node is a neighbour if a walk leads to it. Without ``retrieved`` all of a view counts as retrieved.

    Rounds: the most promising neighbours and the links among them, both of bounded number, are grown by the rule; then all neighbours of what came are checked at once for one
    that should have come before, and what is right is kept. Each round takes one node at least, usually very many.
    """
    spark = activation.sparkSession
    nodes = activation.select("id", "activation")
    ways = saved(walks(edges).where("src <> dst").select("src", "dst"))  # one end is looked up in the view, the other meets ``nodes`` then
    limit = max(1, limit)
    first = nodes.orderBy(F.desc("activation"), "id").limit(max(1, int(limit * share))).collect()
    shown = nodes.join(retrieved.select("id").distinct(), "id", "left_semi").orderBy(F.desc("activation"), "id").limit(limit).collect() if retrieved is not None else []
    view = list(dict.fromkeys((r.id, r.activation) for r in [*shown, *first]))[:limit]
    seeds, kind = len(view), nodes.schema["id"].dataType.simpleString()
    steps = lambda ids: F.broadcast(spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"id {kind}, step int"))  # noqa: E731  as long as the view

    def around(ids: list, first_step: int) -> DataFrame:
        """(id, step, reach, pull): walks to a node outside from those of the view, and from it into them, by the step at which they came (0: the first ``first_step``)."""
        s = steps(ids).withColumn("step", F.greatest(F.lit(0), F.col("step") - first_step + 1))
        to = ways.join(s.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "step", F.lit(1).alias("reach"), F.lit(0).alias("pull"))
        into = ways.join(s.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "step", F.lit(0).alias("reach"), F.lit(1).alias("pull"))
        return to.unionByName(into).join(s.select("id"), "id", "left_anti").groupBy("id", "step").agg(F.sum("reach").alias("reach"), F.sum("pull").alias("pull"))

    while grow and len(view) < limit:
        ids = [i for i, _ in view]
        missing = limit - len(view)
        pool = around(ids, len(ids)).where("reach > 0").join(nodes, "id").orderBy(F.desc("pull"), F.desc("activation"), "id").limit(TRIED * missing + limit).collect()
        if not pool:
            break
        tried = F.broadcast(spark.createDataFrame([(r.id,) for r in pool], f"id {kind}"))
        inner = ways.join(tried.withColumnRenamed("id", "src"), "src").join(tried.withColumnRenamed("id", "dst"), "dst").groupBy("src", "dst").agg(F.count("*").alias("n")).collect()  # both ends in the pool
        grown = _grown([(r.id, r.activation, r.pull) for r in pool], inner, missing)
        # is there a node that would have come before one of these? a row for each state of each neighbour, against what came while it was in it
        state = Window.partitionBy("id").orderBy("step")
        seen = around([*ids, *[g[0] for g in grown]], len(ids)).withColumns({"reach": F.sum("reach").over(state), "pull": F.sum("pull").over(state), "until": F.lead("step", 1, len(grown) + 1).over(state)}).where("reach > 0").join(nodes, "id")
        came = spark.createDataFrame([([(k, pull, float(act), i) for k, (i, act, pull) in enumerate(grown)] + [(len(grown), -1, 0.0, None)] * (len(grown) < missing),)], f"came array<struct<k:int,pull:long,act:double,id:{kind}>>")
        before = F.filter(F.slice("came", F.col("step") + 1, F.col("until") - F.col("step")), lambda x: (F.col("pull") > x.pull) | ((F.col("pull") == x.pull) & ((F.col("activation") > x.act) | ((F.col("activation") == x.act) & (F.col("id") < x.id)))))
        wrong = seen.crossJoin(F.broadcast(came)).agg(F.min(F.get(before, F.lit(0)).k)).first()[0]  # one row of what came
        view += [(i, act) for i, act, _ in (grown if wrong is None else grown[:wrong])]
        if wrong is None:
            break
    low, high = min(a for _, a in view) if view else 0.0, max(a for _, a in view) if view else 0.0
    marked = {r.id for r in shown}
    rows = [(i, float(a), float((a - low) / ((high - low) or 1.0)), k < seeds, retrieved is None or i in marked, k) for k, (i, a) in enumerate(view)]
    return spark.createDataFrame(rows, f"id {kind}, activation double, activation_norm double, seed boolean, retrieved boolean, position int")


def _grown(pool: list[tuple], inner: list, most: int) -> list[tuple]:
    """(id, activation, walks into the view) of nodes as they come, among (id, activation, walks into the view) and the walks (src, dst, n) between these."""
    left = {i: (act, pull) for i, act, pull in pool}
    into: dict = {}
    for src, dst, n in inner:
        into.setdefault(dst, []).append((src, n))
    out = []
    while left and len(out) < most:
        best = min(left, key=lambda i: (-left[i][1], -left[i][0], i))
        act, pull = left.pop(best)
        out.append((best, act, pull))
        for src, n in into.get(best, ()):
            if src in left:
                left[src] = (left[src][0], left[src][1] + n)
    return out


def view_edges(view: DataFrame, edges: DataFrame, most: int = 400) -> DataFrame:
    """The edges inside a view (id, retrieved), at most ``most``: those between retrieved nodes, then those that touch one, then the others; the heaviest first, then by id."""
    marks = F.broadcast(view.select("id", "retrieved"))  # as long as the view
    end = lambda name: marks.select(F.col("id").alias(name), F.col("retrieved").cast("int").alias(f"_{name}"))
    inner = edges.join(end("src"), "src").join(end("dst"), "dst")
    return inner.orderBy(F.desc(F.col("_src") + F.col("_dst")), F.desc(F.abs("weight")), "id").limit(most).select(edges.columns)


#: what a node keeps when it is projected again, and lists that join
TELEMETRY, JOINED = ("activation", "last_recalled", "recall_count", "practice_times", "created_at"), ("owners", "external_refs", "aliases")


def projected_upsert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after projecting ``new`` ones (one per id): a known one of the same kind takes the new columns but keeps its telemetry, lists of owners, references and aliases join,
    and what is scoped to the character stays so; one of another kind is replaced as a whole. Columns that ``new`` lacks stay."""
    given = [c for c in new.columns if c not in ("id", "kind")]
    side = new.select(F.col("id").alias("_id"), F.col("kind").alias("_kind"), *[F.col(c).alias(f"_{c}") for c in given])
    both = nodes.join(side, F.col("id") == F.col("_id"), "full_outer")
    kept, fresh = F.col("_id").isNull(), F.col("id").isNull() | (F.col("kind") != F.col("_kind"))

    def value(c: str) -> Column:
        old = F.col(c) if c in nodes.columns else F.lit(None).cast(new.schema[c].dataType)
        if c == "id":
            return F.coalesce("id", "_id")
        if c == "kind":
            return F.coalesce("_kind", "kind")
        if c not in given:
            return F.when(kept | ~fresh, old)
        own = F.col(f"_{c}")
        if c in TELEMETRY:
            again = F.coalesce(old, own)
        elif c in JOINED:
            none = F.array().cast(new.schema[c].dataType)
            again = F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(own, none)))
        else:
            again = F.coalesce(old, F.lit(False)) | F.coalesce(own, F.lit(False)) if c == "character_scoped" else own
        return F.when(kept, old).when(fresh, own).otherwise(again)

    every = [*nodes.columns, *[c for c in new.columns if c not in nodes.columns]]
    return both.select(*[value(c).alias(c) for c in every])


def updated_graph(nodes: DataFrame, edges: DataFrame, changed: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """An incremental update: changed nodes are projected again (``projected_upsert``), changed edges merge with those of their ids, all others stay."""
    new_nodes, new_edges = changed
    merged = merged_edges(edges.join(new_edges.select("id"), "id", "left_semi").unionByName(new_edges, allowMissingColumns=True))
    return projected_upsert(nodes, new_nodes), edges.join(new_edges.select("id"), "id", "left_anti").unionByName(merged, allowMissingColumns=True)


def mentioned(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, node), once each, for texts (id, text) in which a label (node, label) of three characters or more stands as whole words, case aside.

    A dictionary join: the words of a label are looked up among the runs of as many words of each text, and only what has them is searched for the label as it is written,
    borders included. A label without any letter, digit or underscore is not looked for.
    """
    own = labels.select("node", F.trim("label").alias("label")).where(F.length("label") >= 3).withColumn("words", T.tokens(F.col("label"))).where(F.size("words") > 0).distinct()
    own = own.select("node", "label", F.size("words").alias("n"), F.array_join("words", " ").alias("run"))
    lengths = [r.n for r in own.select("n").distinct().collect()]  # numbers of words in a label
    if not lengths:
        return texts.select("id", F.lit(None).cast(labels.schema["node"].dataType).alias("node")).limit(0)
    words = texts.select("id", T.tokens(F.col("text")).alias("w"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    each = F.flatten(F.array(*[F.when(F.size("w") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in lengths]))
    found = words.select("id", F.explode(F.array_distinct(each)).alias("run")).join(own, "run").select("id", "node", "label")
    return found.join(texts.select("id", "text"), "id").where(T.mentions(F.col("text"), F.col("label"))).select("id", "node").distinct()


def heartbeat_graph(nodes: DataFrame, edges: DataFrame, rows: DataFrame, labels: DataFrame, *, least: float = 0.6, most: int = 200, per: str = "character") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after projecting journal rows (id, kind, summary, importance, created_at, character): findings become facts, actions episodes, of the ``most`` weightiest of
    each character that weigh ``least``; blank summaries are left out.

    Each has an edge from the self and from every person or entity that its summary mentions (labels: node, label), and these become the character's; edges of before that attribute it
    go, learned ones stay. Nodes of earlier projections that are no longer wanted go with their edges.
    """
    kind, weight = F.lower(F.trim("kind")), T.clip(F.col("importance"))
    order = Window.partitionBy(per).orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), F.desc(F.coalesce("created_at", F.lit(0.0))), F.desc("id"))
    admitted = rows.where(kind.isin("discovery", "action") & (weight >= least)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    found = kind == "discovery"
    key = F.col("id").cast("string")
    own = admitted.where(F.trim("summary") != "").select(
        F.concat(F.when(found, "fact").otherwise("episode"), F.lit(":heartbeat:"), key).alias("id"), F.when(found, "fact").otherwise("episode").alias("kind"),
        F.concat(F.when(found, "Heartbeat finding: ").otherwise("Heartbeat action: "), F.trim("summary")).alias("text"), F.trim("summary").alias("content"), weight.alias("importance"),
        F.when(found, 0.5).alias("confidence"), F.col("created_at"), F.when(~found, F.col("created_at")).alias("timestamp"), F.concat(F.lit("heartbeat:"), key).alias("source"), F.lit(True).alias("character_scoped"),
    )
    own = saved(own)
    ends = mentioned(own.select("id", F.col("content").alias("text")), labels).select("id", F.col("node").alias("end"))
    ends = saved(ends.where("id <> end").unionByName(own.select("id", F.lit("self").alias("end"))).distinct())
    wide = own.select(*[c for c in own.columns if c in nodes.columns])
    left, kept = removed(projected_upsert(nodes, wide), edges, stale(nodes, "heartbeat:", own))
    scoped_ = left.join(ends.select(F.col("end").alias("id")).distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("character_scoped", F.coalesce(F.col("character_scoped"), F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    touched = lambda end: own.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    stay = kept.join(touched("src"), "src", "left").join(touched("dst"), "dst", "left")
    stay = stay.where(~(F.col("kind").isin("fact", "episode") & (F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False))))).select(edges.columns)
    new = ends.join(own.select("id", "kind", "importance"), "id").select(
        S.edge_id(F.col("kind"), F.col("end"), F.col("id")).alias("id"), "kind", F.col("end").alias("src"), F.col("id").alias("dst"), F.greatest(F.lit(0.3), 0.3 + 0.5 * F.col("importance")).alias("weight"),
    )
    return scoped_.select(left.columns), stay.unionByName(new, allowMissingColumns=True)


def same_graph(index: DataFrame, nodes: DataFrame) -> bool:
    """Whether an index (id, text) holds exactly the chunks of the graph."""
    own = text_chunks(nodes).select("id", "text")
    return index.select("id", "text").exceptAll(own).isEmpty() and own.exceptAll(index.select("id", "text")).isEmpty()


#: pairs of a task, and of the members of one key that meet in one task
PAIRS, CELL = 1_000_000, 4_000_000


def shared_pairs(members: DataFrame, node: str = "node", key: str = "participant") -> DataFrame:
    """(a, b) pairs of nodes, a before b, that share a key, each once. The result itself is a row per pair.

    Keys are dealt over so many tasks that each makes about PAIRS pairs, however many there are; members of a key of more than CELL pairs meet in several tasks.
    """
    m = saved(members.select(F.col(node).alias("a"), F.col(key).alias("key")).where(F.col(key).isNotNull()).distinct())
    sizes = m.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total, most = sizes.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.max("n")).first()
    if total is None:
        return m.select("a", F.col("a").alias("b")).limit(0)
    cells = F.ceil(F.col("n").cast("double") * F.col("n") / CELL).cast("int")
    if most * most > CELL:
        m = m.join(saved(sizes.withColumn("cells", cells).where("cells > 1").select("key", "cells")), "key", "left").fillna({"cells": 1})
    else:
        m = m.withColumn("cells", F.lit(1))
    tasks = max(1, math.ceil(total / PAIRS))
    a = m.select("a", "key", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int").alias("cell")).repartition(tasks, "key", "cell")
    b = m.select(F.col("a").alias("b"), "key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).repartition(tasks, "key", "cell")
    return a.join(b.hint("merge"), ["key", "cell"]).where("a < b").select("a", "b").distinct()


def pair_edges(pairs: DataFrame, kind: str, weight: float) -> DataFrame:
    return pairs.select(S.edge_id(F.lit(kind), F.col("a").cast("string"), F.col("b").cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(weight).alias("weight"))


def fact_edge_weight(importance: Column) -> Column:
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.3 + 0.7 * importance))


def episode_edge_weight(impact: Column, importance: Column) -> Column:
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.3 + 0.7 * impact + 0.3 * importance))


def relation_edge_weight(dims: Column) -> Column:
    mean = F.aggregate(F.map_values(dims), F.lit(0.0), lambda s, x: s + F.abs(x)) / F.greatest(F.lit(1), F.size(dims))
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.3 + 0.7 * mean))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row per id: the largest weight and recall count, signed attributes by magnitude; of the two directions of a symmetric edge the one whose source is less."""
    ends = F.struct("src", "dst")
    by_size = [F.max_by(c, F.abs(c)).alias(c) for c in ("valence", "trust", "affection") if c in edges.columns]
    counts = [F.max(c).alias(c) for c in ("co_recall_count",) if c in edges.columns]
    return edges.groupBy("id").agg(F.min("kind").alias("kind"), F.min(ends).getField("src").alias("src"), F.min(ends).getField("dst").alias("dst"), F.max("weight").alias("weight"), *by_size, *counts)


def rewired(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges moved to survivors (id, survivor); self-loops that this makes go; an id taken already gets ::m1, ::m2, ..."""
    s = survivors.select(F.col("id").alias("_id"), F.col("survivor").alias("_to"))
    out = edges
    for end in ("src", "dst"):
        moved = F.coalesce("_to", end)
        out = out.join(s, F.col(end) == F.col("_id"), "left").withColumns({end: moved}).drop("_id", "_to")
    old = F.col("id")
    out = out.where("src <> dst").withColumn("_new", S.edge_id(F.col("kind"), F.col("src").cast("string"), F.col("dst").cast("string")))
    order = Window.partitionBy("_new").orderBy(F.when(old == F.col("_new"), 0).otherwise(1), old)
    out = out.withColumn("_n", F.row_number().over(order) - 1)
    return out.withColumn("id", F.when(F.col("_n") == 0, F.col("_new")).otherwise(F.concat("_new", F.lit("::m"), F.col("_n")))).drop("_n", "_new")


def label_components(labels: DataFrame) -> DataFrame:
    """(id, component), as a table: nodes that share a label, directly or over others, have the least id that they reach. labels: (id, label).

    Least ids pass over labels and then jump to their own least id until nothing changes: components only grow less, so this ends; chains settle in about the logarithm of their length.
    """
    own = saved(labels.where("label is not null").distinct())
    now = saved(own.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        by_label = saved(own.join(now, "id").groupBy("label").agg(F.min("component").alias("least")))  # a table of its own: a hot label can be split
        reached = own.join(by_label, "label").groupBy("id").agg(F.min("least").alias("least"))
        step = now.join(reached, "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = saved(step.join(jump, "component", "left").select("id", F.coalesce("root", "component").alias("component"), "before"))
        moved = not new.where("component <> before").isEmpty()
        released(by_label, now)
        now = new
        if not moved:
            released(own)
            return now.select("id", "component")


def survivors(persons: DataFrame, components: DataFrame) -> DataFrame:
    """(id, survivor): the oldest of each component (to the millisecond; one without a time is the youngest), then one with a user id of a platform, which has a digit or a capital, then
    the longest name, then the least id."""
    born = F.round(F.coalesce(F.nullif(F.col("created_at").cast("double"), F.lit(0.0)), F.lit(1e18)), 3)
    rank = F.struct(born, ~F.coalesce("user_id", F.lit("")).rlike("[0-9A-Z]"), -F.length(F.coalesce("name", F.lit(""))), F.col("id"))
    best = persons.join(components, "id").groupBy("component").agg(F.min_by("id", rank).alias("survivor"))
    return components.join(best, "component").select("id", "survivor")


def merged_persons(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merges) after folding persons that share a label (name, alias or user id, case aside), directly or over others; merges: (id, survivor) of the persons that go.

    nodes: id, kind, name, user_id, aliases, created_at, text and, if they have them, user_ids, owners, external_refs, character_scoped. A survivor takes the longest name of its group, all other
    names and aliases as aliases, all user ids, owners and references (in order), and reads like its names; edges move to it (``rewired``).
    """
    none = F.array().cast("array<string>")
    people = saved(nodes.where("kind = 'person'"))
    ids = F.array_append(F.coalesce("user_ids", none) if "user_ids" in nodes.columns else none, F.col("user_id"))
    labels = people.select("id", F.explode(F.concat(F.array("name"), ids, F.coalesce("aliases", none))).alias("label")).where("label <> ''").select("id", F.lower("label").alias("label"))
    merges = saved(survivors(people, label_components(labels)))
    groups = merges.groupBy("survivor").agg(F.count("*").alias("n")).where("n > 1").select("survivor")
    gone = saved(merges.join(groups, "survivor").where("id <> survivor").select("id", "survivor"))
    own = people.join(merges.join(groups, "survivor"), "id")
    first = F.struct(-F.length(F.coalesce("name", F.lit(""))), F.col("id") != F.col("survivor"), F.col("id"))
    name = own.groupBy("survivor").agg(F.min_by("name", first).alias("name"))
    lists = {"aliases": F.concat(F.array("name"), F.coalesce("aliases", none)), "user_ids": ids} | {c: F.coalesce(c, none) for c in ("owners", "external_refs") if c in nodes.columns}
    marked = lambda c: lambda x: F.struct(F.lit(c).alias("list"), x.alias("item"))
    each = own.select("survivor", F.explode(F.concat(*[F.transform(v, marked(c)) for c, v in lists.items()])).alias("x")).select("survivor", "x.*")
    sets = each.where("item <> ''").groupBy("survivor").agg(*[F.array_sort(F.collect_set(F.when(F.col("list") == c, F.col("item")))).alias(c) for c in lists])
    new = name.join(sets, "survivor").withColumn("aliases", F.array_remove("aliases", F.col("name")))
    if "character_scoped" in nodes.columns:
        new = new.join(own.groupBy("survivor").agg(F.max("character_scoped").alias("character_scoped")), "survivor")
    new = new.withColumn("text", T.joined_names(F.col("name"), F.col("aliases")))
    wide = [c for c in new.columns if c in nodes.columns]
    side = new.select(F.col("survivor").alias("_id"), *[F.col(c).alias(f"_{c}") for c in wide])
    left = nodes.join(gone.select("id"), "id", "left_anti").join(side, F.col("id") == F.col("_id"), "left")
    out = left.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in wide else F.col(c) for c in nodes.columns])
    return out, rewired(edges, gone), gone


def hebbian(edges: DataFrame, fired: DataFrame, *, threshold: float = FIRE, step: float = STEP, cap: float = 0.10) -> DataFrame:
    """Co-occurrence edges (src, dst, weight, creation_weight, co_recall_count) after a recall: nodes fired together gain ``step``, up to ``cap`` above creation.

    A new pair is created with the weight ``step`` and gains like any other. fired: (recall, id, activation); a recall's fired nodes are a bounded answer, and the result is a row per pair.
    """
    f = fired.where(F.col("activation") >= threshold).withColumnRenamed("id", "node")
    pairs = shared_pairs(f, "node", "recall").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(True).alias("_fired"))
    both = edges.join(pairs, ["src", "dst"], "full_outer")
    hit, made = F.coalesce("_fired", F.lit(False)), F.coalesce("creation_weight", F.when(F.col("weight").isNull(), F.lit(step)).otherwise(F.lit(0.0)))
    weight = F.when(hit, F.least(F.coalesce("weight", F.lit(step)) + step, made + cap)).otherwise(F.col("weight"))
    return both.select("src", "dst", weight.alias("weight"), made.alias("creation_weight"), (F.coalesce("co_recall_count", F.lit(0)) + F.when(hit, 1).otherwise(0)).cast("long").alias("co_recall_count"))


def fed_back(nodes: DataFrame, pairs: DataFrame, surfaced: DataFrame, now: float, *, threshold: float = FIRE) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs) after a recall that surfaced nodes (id, score), once each at their best however many participants saw them: they are touched, and those active enough wire together.

    nodes: id, recall_count, last_recalled and, if they have them, activation and practice_times; pairs: the co-occurrence edges as in ``hebbian``. What surfaced fits a budget of tokens, so
    it is a bounded answer. A preview leaves this step out.
    """
    best = saved(surfaced.groupBy("id").agg(F.max("score").alias("_score")))  # both results need it
    out, hit = nodes.join(best, "id", "left"), F.col("_score").isNotNull()
    changes = {"recall_count": F.coalesce("recall_count", F.lit(0)) + F.when(hit, 1).otherwise(0), "last_recalled": F.when(hit, F.lit(now)).otherwise(F.col("last_recalled"))}
    if "activation" in nodes.columns:
        changes["activation"] = F.when(hit, F.greatest("activation", "_score")).otherwise(F.col("activation"))
    if "practice_times" in nodes.columns:
        times = F.coalesce("practice_times", F.array().cast("array<double>"))
        changes["practice_times"] = F.when(hit, F.concat(times, F.array(F.lit(now)))).otherwise(F.col("practice_times"))
    fired = best.join(nodes.select("id"), "id", "left_semi").select(F.lit(0).alias("recall"), "id", F.col("_score").alias("activation"))
    return out.withColumns(changes).select(nodes.columns), hebbian(pairs, fired, threshold=threshold)


def owners_from_content(nodes: DataFrame, edges: DataFrame, content_kinds: tuple[str, ...] = ("fact", "episode")) -> DataFrame:
    """Owners of content nodes flow one edge far to its direct endpoints, not farther."""
    content = nodes.where(F.col("kind").isin(*content_kinds)).select(F.col("id").alias("_c"), F.col("owners").alias("_o"))
    ends = edges.where(~F.col("kind").isin(*SYMMETRIC))
    flow = ends.select(F.col("src").alias("_c"), F.col("dst").alias("id")).unionByName(ends.select(F.col("dst").alias("_c"), F.col("src").alias("id")))
    gained = flow.join(content, "_c").select("id", F.explode("_o").alias("_o")).groupBy("id").agg(F.collect_set("_o").alias("_gained"))
    return nodes.join(gained, "id", "left").withColumn("owners", F.array_sort(F.array_union(F.coalesce("owners", F.array().cast("array<string>")), F.coalesce("_gained", F.array().cast("array<string>"))))).drop("_gained").select(nodes.columns)


def removed(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and every edge that touches one."""
    gone = ids.select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(edges.columns)


def stale(nodes: DataFrame, prefix: str, desired: DataFrame) -> DataFrame:
    """Ids of projected nodes, by the prefix of their source, that are no longer wanted."""
    return nodes.where(F.col("source").startswith(prefix)).join(desired.select("id"), "id", "left_anti").select("id")


def seed_activations(hits: DataFrame, extra: DataFrame | None = None, base: float = 4.0, gain: float = 3.0) -> DataFrame:
    """(query_id, id, activation) from ranked hits (query_id, id, rank from 0, relevance, score): good ranks and scores seed more."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    own = hits.select("query_id", "id", (base * (1 - 0.6 * F.col("rank") / n) * F.col("relevance") + gain * F.col("score")).alias("activation"))
    own = own.unionByName(extra) if extra is not None else own
    return own.groupBy("query_id", "id").agg(F.sum("activation").alias("activation"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"))


def render_order(items: DataFrame) -> DataFrame:
    """Items in the order in which a group reads them: persons, facts, episodes, entities, the self; then by score."""
    kinds = ["person", "fact", "episode", "entity", "self"]
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return items.orderBy(place, F.desc("score"), "id")


def self_survivors(persons: DataFrame, labels: list[str]) -> DataFrame:
    """(id, survivor='self') of the persons (id, name, aliases) one of whose labels is the character's own, case aside; give it to ``rewired``."""
    own = F.array(*[F.lit(x.strip().lower()) for x in labels])
    names = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)))
    return persons.where(F.arrays_overlap(names, own)).select("id", F.lit("self").alias("survivor"))


def resolved_entities(mentions: DataFrame, entities: DataFrame, slug) -> DataFrame:
    """mentions (id, name) with the entity they mean: the one whose id is the name's slug, else one whose name or alias has that slug (the least id), else a new one."""
    labels = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n")).select("id", slug(F.col("_n")).alias("_slug"))
    by_label = labels.groupBy("_slug").agg(F.min("id").alias("_by_label"))
    by_id = entities.select(F.col("id").alias("_by_id")).distinct()
    out = mentions.withColumn("_slug", slug(F.col("name"))).withColumn("_own", F.concat(F.lit("entity:"), F.col("_slug")))
    out = out.join(by_id, F.col("_own") == F.col("_by_id"), "left").join(by_label, "_slug", "left")
    return out.select(*mentions.columns, F.coalesce("_by_id", "_by_label", "_own").alias("entity"))


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes reached over at most ``hops`` walks from the seeds (id), with the fewest; one join per hop."""
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).distinct()
        front = step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen
