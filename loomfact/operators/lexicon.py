"""Lexical graph operations over WordNet-like fact tables.

Tables: synset(id, pos), lemma(id, text, language), sense(id, lemma, synset, frequency),
gloss(synset, text), example(synset, text), exception(surface, lemma),
frequency(synset, count) and edge tables, of which hypernym has (child, parent).

``RULES`` has the views that rules call by name, with the arguments they fix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Table, stored
from .hierarchy import closure, fixpoint


#: Rounds in which dead ends are cut off at most, before paths are searched.
CUTS = 16


def dead_ends(edges: DataFrame, rounds: int = CUTS) -> tuple[DataFrame, DataFrame]:
    """(node, up) of the nodes of a symmetric graph (a, b) that are cut off, each with its only neighbour left, and the edges that remain.

    A node of one neighbour can only begin or end a path.  With those gone others become
    such nodes, so a tree goes whole, leaves first.
    """
    ups = Table(edges.sparkSession, "dead-ends")
    for k in range(rounds):
        single = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("up")).where("n = 1").select(F.col("a").alias("node"), "up")
        # of two nodes that have only each other, one stays
        other = single.select(F.col("node").alias("up"), F.lit(True).alias("both"))
        gone = ups.add(single.join(other, "up", "left").where("both is null or node < up").select("node", "up"))
        if gone.isEmpty():
            break
        for side in ("a", "b"):
            edges = edges.join(gone.select(F.col("node").alias(side)), side, "left_anti")
        edges = stored(edges.select("a", "b"), "edges")
    return ups.all(), edges


@dataclass
class Lexicon:
    synset: DataFrame
    lemma: DataFrame
    sense: DataFrame
    gloss: DataFrame
    example: DataFrame
    exception: DataFrame
    frequency: DataFrame
    hypernym: DataFrame

    def lookup(self, text: str, language: str | None = None, pos: str | None = None) -> DataFrame:
        """Senses of a lemma, most frequent first."""
        lemma = self.lemma.where(F.lower("text") == text.lower())
        if language:
            lemma = lemma.where(F.col("language") == language)
        found = lemma.select(F.col("id").alias("lemma"), "text", "language").join(self.sense.select(F.col("id").alias("sense"), "lemma", "synset", "frequency"), "lemma")
        found = found.join(self.synset.select(F.col("id").alias("synset"), "pos"), "synset")
        return (found.where(F.col("pos") == pos) if pos else found).orderBy(F.desc("frequency"), "synset")

    def lemmatize(self, words: DataFrame, word: str = "word") -> DataFrame:
        """(word, lemma): exceptions, the word itself, ies to y, s to nothing; attested lemmas only."""
        w = F.lower(F.col(word))
        cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
        forms = words.select(F.col(word).alias("word"), F.explode(F.array_compact(F.array(w, F.when(w.endswith("ies"), F.concat(cut(3), F.lit("y"))), F.when(w.endswith("s"), cut(1))))).alias("lemma"))
        special = words.select(F.col(word).alias("word"), w.alias("surface")).join(self.exception.select(F.lower("surface").alias("surface"), F.col("lemma")), "surface").select("word", "lemma")
        attested = self.lemma.select(F.lower("text").alias("lemma")).distinct()
        return forms.unionByName(special).distinct().join(attested, "lemma", "left_semi").select("word", "lemma")

    def traverse(self, start: DataFrame, edges: DataFrame | None = None, direction: str = "out", max_depth: int = 32) -> DataFrame:
        """(start, node, depth, path) reached from start (column synset), breadth first; direction out, in or both."""
        e = (edges if edges is not None else self.hypernym).select(F.col("child").alias("a"), F.col("parent").alias("b"))
        back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        e = {"out": e, "in": back, "both": e.unionByName(back)}[direction].distinct()
        first = start.select(F.col("synset").alias("start"), F.col("synset").alias("node"), F.lit(0).alias("depth"), F.array("synset").alias("path")).distinct()
        step = lambda new: new.where(F.col("depth") < max_depth).join(e, new.node == e.a).groupBy("start", F.col("b").alias("node")).agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), F.concat("path", F.array("b")).alias("path"))).alias("k")).select("start", "node", "k.depth", "k.path")
        return fixpoint(first, step, ["start", "node"]).where("depth > 0")

    def shortest_path(self, pairs: DataFrame, max_depth: int = 64) -> DataFrame:
        """(l, r, distance, path) of pairs of synsets, along hypernyms in either direction; null where none leads there.

        All pairs are searched side by side, ring by ring; a pair leaves the search as soon as
        it is found.  Dead ends are left upwards only, and entered only where they lead to the
        pair's end, so the thousands of leaves below a node cost a pair nothing.
        """
        e = self.hypernym.select(F.col("child").alias("a"), F.col("parent").alias("b"))
        e = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
        ups, core = dead_ends(e)
        asked = stored(pairs.select("l", "r").distinct(), "pairs")
        ends = fixpoint(asked.select(F.col("r").alias("end"), F.col("r").alias("node")).distinct(), lambda new: new.join(ups, "node").select("end", F.col("up").alias("node")), ["end", "node"])
        downs = stored(ends.join(ups, "node").select(F.col("end").alias("r"), F.col("up").alias("node"), F.col("node").alias("b")), "downs")
        onward = core.select(F.col("a").alias("node"), "b").unionByName(ups.select("node", F.col("up").alias("b")))
        seen, found = Table(asked.sparkSession, "rings"), Table(asked.sparkSession, "found")
        ring = seen.add(asked.select("l", "r", F.col("l").alias("node"), F.array("l").alias("path")))
        for _ in range(max_depth + 1):
            hit = found.add(ring.where("node = r"))
            left = ring if hit.isEmpty() else ring.join(hit.select("l", "r"), ["l", "r"], "left_anti")
            moves = left.join(onward, "node").select("l", "r", "path", "b").unionByName(left.join(downs, ["r", "node"]).select("l", "r", "path", "b"))
            step = moves.groupBy("l", "r", F.col("b").alias("node")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
            ring = seen.add(step.join(seen.all().select("l", "r", "node"), ["l", "r", "node"], "left_anti").select("l", "r", "node", "path"))
            if ring.isEmpty():
                break
        return asked.join(found.all().select("l", "r", (F.size("path") - 1).alias("distance"), "path"), ["l", "r"], "left")

    def information_content(self, closed: DataFrame | None = None) -> DataFrame:
        """(synset, ic): -ln((counts below + 1) / (all counts + number of synsets))."""
        closed = closed if closed is not None else closure(self.hypernym)
        every = self.synset.select(F.col("id").alias("synset"))
        counts = self.frequency.groupBy("synset").agg(F.sum("count").alias("c"))
        total = every.join(counts, "synset", "left").agg((F.coalesce(F.sum("c"), F.lit(0)) + F.count(F.lit(1))).alias("t"))
        ancestry = closed.select(F.col("descendant").alias("synset"), "ancestor").unionByName(every.select("synset", F.col("synset").alias("ancestor"))).distinct()
        below = ancestry.join(counts, "synset", "left").groupBy(F.col("ancestor").alias("synset")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
        return below.crossJoin(total).select("synset", (-F.ln((F.col("c") + 1) / F.col("t"))).alias("ic"))

    def closed(self) -> DataFrame:
        """(descendant, ancestor, depth) of all synsets, those without edges too."""
        every = self.synset.select(F.col("id").alias("descendant"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
        return closure(self.hypernym).unionByName(every).distinct()

    def common_subsumers(self, pairs: DataFrame, closed: DataFrame | None = None) -> DataFrame:
        """(l, r, ancestor, depth, ic): common ancestors of each pair; depth counts the synsets up to a root, 1 for a root."""
        closed = stored(self.closed(), "closure") if closed is None else closed
        depth = closed.groupBy(F.col("descendant").alias("ancestor")).agg((F.max("depth") + 1).alias("depth"))
        left, right = (closed.select(F.col("descendant").alias(s), "ancestor") for s in ("l", "r"))
        ic = self.information_content(closed).withColumnRenamed("synset", "ancestor")
        return pairs.select("l", "r").distinct().join(left, "l").join(right, ["r", "ancestor"]).join(depth, "ancestor").join(ic, "ancestor", "left").select("l", "r", "ancestor", "depth", "ic")

    def similarity(self, pairs: DataFrame) -> DataFrame:
        """Every pair's distance along hypernyms, its deepest common ancestor (the first by name among equals), and path, wup, resnik, lin, jcn and lch similarity; lch falls back to path, and what nothing connects scores 0."""
        closed = stored(self.closed(), "closure")
        best = self.common_subsumers(pairs, closed).groupBy("l", "r").agg(F.min(F.struct((-F.col("depth")).alias("up"), "ancestor")).alias("k")).select("l", "r", F.col("k.ancestor").alias("lcs"), (-F.col("k.up")).alias("depth"))
        out = self.shortest_path(pairs).drop("path").join(best, ["l", "r"], "left")
        depth = closed.groupBy(F.col("descendant").alias("s")).agg((F.max("depth") + 1).alias("n"))
        ic = stored(self.information_content(closed), "ic")
        for side, name in (("l", "il"), ("r", "ir"), ("lcs", "ic")):
            out = out.join(ic.select(F.col("synset").alias(side), F.col("ic").alias(name)), side, "left")
        for side, name in (("l", "nl"), ("r", "nr")):
            out = out.join(depth.select(F.col("s").alias(side), F.col("n").alias(name)), side, "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        path, both, shared = zero(1 / (F.col("distance") + 1)), zero(F.col("il")) + zero(F.col("ir")), zero(F.col("ic"))
        return out.select("l", "r", "lcs", "distance", path.alias("path"), zero(2 * F.col("depth") / (F.col("nl") + F.col("nr"))).alias("wup"), shared.alias("resnik"), F.when(both > 0, 2 * shared / F.when(both > 0, both)).otherwise(0.0).alias("lin"), (1 / (both - 2 * shared + 1)).alias("jcn"), path.alias("lch"))

    def word_similarity(self, left: str, right: str, language: str = "en") -> DataFrame:
        """Similarity of the most frequent senses of two words; no row where one has none."""
        first = lambda w, name: self.lookup(w, language).limit(1).select(F.col("synset").alias(name))
        return self.similarity(first(left, "l").crossJoin(first(right, "r")))

    def synonyms(self, text: str, language: str | None = None) -> DataFrame:
        """Other lemmas with a sense in a synset of the text."""
        own = self.lookup(text).select("synset").distinct()
        found = self.sense.join(own, "synset").select("synset", F.col("lemma").alias("id")).join(self.lemma, "id")
        found = found.where(F.col("language") == language) if language else found
        return found.where(F.lower("text") != text.lower()).select("synset", "text", "language").distinct()

    def translate(self, text: str, source: str, target: str) -> DataFrame:
        own = self.lookup(text, source).select("synset").distinct()
        return self.sense.join(own, "synset").select("synset", F.col("lemma").alias("id")).join(self.lemma.where(F.col("language") == target), "id").select("synset", "text").distinct()

    def expand_query(self, text: str) -> DataFrame:
        """The term (weight 1), and its synsets' neighbours one hop up or down (0.5)."""
        own = self.lookup(text).select("synset").distinct()
        near = self.traverse(own, direction="both", max_depth=1).select(F.col("node").alias("synset"), F.lit(0.5).alias("weight"))
        every = own.withColumn("weight", F.lit(1.0)).unionByName(near).groupBy("synset").agg(F.max("weight").alias("weight"))
        return every.join(self.sense.select("synset", F.col("lemma").alias("id")), "synset").join(self.lemma, "id").groupBy("text").agg(F.max("weight").alias("weight"))

    def lexical_chain(self, terms: DataFrame) -> DataFrame:
        """One chain of all terms (column word): each with its synsets."""
        lemma = self.lemma.select("id", F.lower("text").alias("t"))
        return terms.select(F.lower("word").alias("t")).distinct().join(lemma, "t").join(self.sense.select(F.col("lemma").alias("id"), "synset"), "id").select(F.col("t").alias("word"), "synset").distinct()

    def lesk(self, word: str, context: Column, contexts: DataFrame, id_col: str) -> DataFrame:
        """For each context, the sense of word whose gloss and examples share most tokens with it (the first by synset among equals)."""
        tokens = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda x: x != "")
        texts = self.gloss.unionByName(self.example).groupBy("synset").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
        senses = self.lookup(word).select("synset").distinct().join(texts, "synset", "left").select("synset", tokens(F.coalesce("text", F.lit(""))).alias("sense_tokens"))
        asked = contexts.select(F.col(id_col).alias("id"), tokens(context).alias("tokens"))
        # the senses of one word are few: every context meets each of them
        scored = asked.crossJoin(senses).select("id", "synset", F.size(F.array_intersect("tokens", "sense_tokens")).alias("overlap"))
        return scored.groupBy("id").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "synset")).alias("k")).select("id", "k.synset", (-F.col("k.less")).alias("overlap"))


def _pair(lex: Lexicon, left: str, right: str) -> DataFrame:
    return lex.synset.sparkSession.createDataFrame([(left, right)], "l string, r string")


def _one(lex: Lexicon, value: str, name: str) -> DataFrame:
    return lex.synset.sparkSession.createDataFrame([(value,)], f"{name} string")


#: The rule views: each takes a lexicon and the arguments that the rule leaves open.
RULES = {
    "WordNetLookup": lambda lex, text: lex.lookup(text, "en"),
    "WordNetLemmas": lambda lex, text: lex.lemmatize(_one(lex, text, "word")),
    "WordNetSynonyms": lambda lex, word: lex.synonyms(word, "en"),
    "WordNetAncestors": lambda lex, synset: lex.traverse(_one(lex, synset, "synset"), direction="out", max_depth=32),
    "WordNetDescendants": lambda lex, synset: lex.traverse(_one(lex, synset, "synset"), direction="in", max_depth=32),
    "WordNetDistance": lambda lex, left, right: lex.shortest_path(_pair(lex, left, right)),
    "WordNetSimilarity": lambda lex, left, right, algorithm: lex.similarity(_pair(lex, left, right)).select("l", "r", F.col(ALIASES.get(algorithm, algorithm)).alias("score")),
    "WordNetWordSimilarity": lambda lex, left, right, algorithm: lex.word_similarity(left, right).select(F.col(ALIASES.get(algorithm, algorithm)).alias("score")),
    "WordNetCheckSimilarity": lambda lex, left, right, algorithm: lex.word_similarity(left, right).select(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(ALIASES.get(algorithm, algorithm)).alias("score")).alias("result")),
    "WordNetSense": lambda lex, word, context: lex.lesk(word, F.col("text"), lex.synset.sparkSession.createDataFrame([(0, context)], "id int, text string"), "id"),
    "WordNetExpand": lambda lex, query: lex.expand_query(query),
    "WordNetTranslate": lambda lex, word, source, target: lex.translate(word, source, target),
}
#: Other names of algorithms.
ALIASES = {"wu_palmer": "wup", "wu-palmer": "wup", "jiang_conrath": "jcn", "leacock_chodorow": "lch"}
