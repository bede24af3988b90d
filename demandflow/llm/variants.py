"""Operator 11: grouping of spelling variants by finite-state composition.

The vocabulary is counted by Spark.  Two words are near if one edit (a code point inserted, deleted or replaced) turns one
into the other; such pairs are what the composition *acceptor o one-edit transducer o acceptor* accepts.

**Partitions.**  An edit at place i (the length of the pair's common prefix) lies either at ``HEAD`` or later, so that both
words start with the same ``HEAD`` code points, or before it, so that both end in the same code points.  Every word
therefore goes to two groups, one by its start and one by its (reversed) end, and each pair is met in exactly one.  A
group is the part of the composition that starts in one pair of equal states: those that the shared code points lead to.
Groups of more than ``GROUP_WORDS`` words are dealt anew by narrower ranges of edit places (both sides of the range are
then shared), down to one place, where a group has at most as many words as the alphabet has letters (the shorter length: one free
code point) and pairs of letters (the longer: two).  No group is cut, capped or dropped.

**In a task** the groups of a bucket make up one minimised acyclic acceptor (equal right languages are merged from the
leaves up), whose arcs know how many words precede them, so that a path is a word's number.  The composition is walked in
breadth by numpy: paths without an edit, pairs of paths born by an edit, pairs advanced along equal letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import LOWER, UPPER, mix, save, table

#: Code points of a word
RUN = "A-Za-z\\u00C0-\\u00FF"
MIN_CHARS = 7
MIN_COUNT = 2
#: One in so many (document, run) has a code point deleted, by crc32
SLIP = 31
#: A form has to be so many times as frequent
FACTOR = 10
#: Edit places before HEAD are found from the words' ends; of those MIN_CHARS - HEAD code points are shared
HEAD = 3
#: Groups with more words are dealt by narrower ranges of edit places
GROUP_WORDS = 50_000
#: Code points that one task's acceptor should hold
BUCKET_CHARS = 1_500_000


# --- vocabulary ----------------------------------------------------------------------------------

def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): words of docs (doc_id, text) with at least min_chars code points that occur at least min_count times."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"([{RUN}]{{{min_chars},}})"), F.lit(1))).alias("run"))
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


# --- groups of the composition --------------------------------------------------------------------

def _key(lo: Column, hi: Column, m: Column) -> tuple[Column, Column]:
    """(group key, path) of a word in the class of edit places [lo, hi) (hi null: no end; m null: any length, by the
    word's end).  The key holds all that the words of the group share; the path is what follows the shared start."""
    w, n = F.col("word"), F.length("word")
    tail = F.lit(MIN_CHARS - HEAD)
    start = F.substring(w, F.lit(1), lo)
    rest = F.substring(w, lo + 1, n)
    end = F.when(m > hi, F.substring(w, n - (m - hi) + 1, n)).otherwise(F.lit(""))
    key = (F.when(F.isnull(hi), F.concat_ws(" ", F.lit("s"), lo, start))
           .when(F.isnull(m), F.concat_ws(" ", F.lit("e"), F.substring(w, n - tail + 1, n)))
           .otherwise(F.concat_ws(" ", F.lit("r"), lo, hi, m, start, F.lit("-"), end)))
    path = F.when(F.isnotnull(hi) & F.isnull(m), F.substring(F.reverse(w), tail + 1, n)).otherwise(rest)
    return key, path


def _class(lo, hi, m) -> Column:
    null = F.lit(None).cast("int")
    return F.struct(*[(null if x is None else (x if isinstance(x, Column) else F.lit(x))).cast("int").alias(c)
                      for x, c in ((lo, "lo"), (hi, "hi"), (m, "m"))])


def _narrower() -> Column:
    """The classes that a hot group's word is dealt to: together they hold every edit place of the group's class once."""
    lo, hi, m, n = F.col("lo"), F.col("hi"), F.col("m"), F.length("word")
    mid = ((lo + hi) / 2).cast("int")
    both = [n - 1, n]
    by_start = [_class(lo, lo * 2, k) for k in both] + [_class(lo * 2, None, None)]
    by_end = [_class(i, i + 1, k) for i in range(HEAD) for k in both]
    by_range = [_class(lo, mid, m), _class(mid, hi, m)]
    classes = F.when(F.isnull(hi), F.array(*by_start)).when(F.isnull(m), F.array(*by_end)).otherwise(F.array(*by_range))
    # an edit at place i needs i code points before it in both words
    return F.filter(classes, lambda c: c["lo"] <= F.coalesce(c["m"], n))


def deal(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, lo, hi, m, key, path): every word in the groups of its edit places, none larger than group_words but
    those of a single place, which their alphabet bounds."""
    def keyed(df):
        key, path = _key(F.col("lo"), F.col("hi"), F.col("m"))
        return df.withColumn("key", key).withColumn("path", path)

    level = keyed(words.select("word", "n", F.explode(F.array(_class(HEAD, None, None), _class(0, HEAD, None))).alias("c"))
                  .select("word", "n", "c.*"))
    done = None
    while True:
        hot = save(level.groupBy("key", "lo", "hi").agg(F.count("*").alias("size")).where(F.col("size") > group_words)
                   .where(F.isnull("hi") | (F.col("hi") - F.col("lo") > 1)).select("key"), "hot_groups")
        if hot.isEmpty():
            return level if done is None else done.unionByName(level)
        calm = level.join(hot, "key", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        level = keyed(level.join(hot, "key", "left_semi").select("word", "n", F.explode(_narrower()).alias("c"))
                      .select("word", "n", "c.*"))


# --- one task: minimised acceptor and composition ---------------------------------------------------

class Acceptor:
    """Minimised acyclic acceptor of sorted distinct (group, path) rows.

    arcs are sorted by (state, label): arc_label, arc_to, arc_skip (words that the state accepts before this arc), first
    (first[s]..first[s+1] are s's arcs), final; starts[g]: the state that group g starts in, base[g]: its first word.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray, offsets: np.ndarray):
        n = len(group)
        length = np.diff(offsets)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        node = np.cumsum(new) - 1  # trie node that each word is at; the groups' start nodes come first
        total = int(node[-1]) + 1 if n else 0
        self.base = np.flatnonzero(new)
        parents, labels, ends, levels = [], [], [node[length == 0]], [(0, total)]
        alive = np.flatnonzero(length > 0)
        depth = 0
        while len(alive):  # one turn per code point of the longest path
            at, label = node[alive], codes[offsets[alive] + depth]
            fresh = np.ones(len(alive), bool)
            fresh[1:] = (at[1:] != at[:-1]) | (label[1:] != label[:-1])
            parents.append(at[fresh])
            labels.append(label[fresh])
            node[alive] = total + np.cumsum(fresh) - 1
            levels.append((total, total + int(fresh.sum())))
            total = levels[-1][1]
            depth += 1
            over = length[alive] == depth
            ends.append(node[alive[over]])
            alive = alive[~over]
        self._minimise(levels, parents, labels, np.concatenate(ends) if n else np.zeros(0, np.int64), total)

    def _minimise(self, levels, parents, labels, ends, total: int) -> None:
        final = np.zeros(total, bool)
        final[ends] = True
        height = np.zeros(total, np.int64)
        parent = np.concatenate([np.full(levels[0][1], -1, np.int64), *parents])
        label = np.concatenate([np.zeros(levels[0][1], np.int64), *[x.astype(np.int64) for x in labels]])
        count = final.astype(np.int64)
        for lo, hi in reversed(levels[1:]):
            p = parent[lo:hi]
            np.maximum.at(height, p, height[lo:hi] + 1)
            np.add.at(count, p, count[lo:hi])
        state = np.zeros(total, np.int64)
        kids = np.flatnonzero(parent >= 0)  # in order of (parent, label) within a level, and of parents overall
        kids = kids[np.argsort(parent[kids], kind="stable")]
        kid_first = np.searchsorted(parent[kids], np.arange(total + 1))
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(int(height.max(initial=-1)) + 2))
        n_states, reps = 0, []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            nodes = by_height[lo:hi]
            n_kids = kid_first[nodes + 1] - kid_first[nodes]
            arcs = kids[spread(kid_first[nodes], n_kids)]
            owner = np.repeat(np.arange(len(nodes)), n_kids)
            h = mix(mix(state[arcs].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + label[arcs].astype(np.uint64))
            sign = np.zeros(len(nodes), np.uint64)
            np.add.at(sign, owner, h)
            sign = mix(sign + final[nodes].astype(np.uint64)) ^ n_kids.astype(np.uint64)
            _, rep, cls = np.unique(sign, return_index=True, return_inverse=True)
            # equal signatures are only a hint: arcs and finality are compared with those of the class's first node
            same = (n_kids == n_kids[rep[cls]]) & (final[nodes] == final[nodes[rep[cls]]])
            other = kids[spread(kid_first[nodes[rep[cls]]], np.where(same, n_kids, 0))]
            mine = np.repeat(same, n_kids)
            differ = (label[arcs[mine]] != label[other]) | (state[arcs[mine]] != state[other])
            same[owner[mine][differ]] = False
            odd = np.flatnonzero(~same)  # a collision of 64-bit signatures: left unmerged, which stays right
            cls[odd] = len(rep) + np.arange(len(odd))
            reps.append(nodes[np.r_[rep, odd]])
            state[nodes] = n_states + cls
            n_states += len(rep) + len(odd)
        rep = np.concatenate(reps) if reps else np.zeros(0, np.int64)
        n_kids = kid_first[rep + 1] - kid_first[rep]
        arcs = kids[spread(kid_first[rep], n_kids)]
        self.first = np.r_[0, np.cumsum(n_kids)]
        self.arc_label, self.arc_to = label[arcs], state[arcs]
        self.final = final[rep]
        before = np.cumsum(count[arcs]) - count[arcs]
        owner = np.repeat(np.arange(len(rep)), n_kids)
        self.arc_skip = before - before[self.first[owner]] + self.final[owner] if len(arcs) else before
        self.starts = state[:levels[0][1]]
        self.n_labels = int(label.max(initial=0)) + 1
        self.arc_key = owner * self.n_labels + self.arc_label

    def advance(self, q, r, i, j):
        """Pairs of states (q, r), at words from i and j on, moved along each label that both have."""
        swap = (self.first[q + 1] - self.first[q]) > (self.first[r + 1] - self.first[r])
        a, b = np.where(swap, r, q), np.where(swap, q, r)
        n = self.first[a + 1] - self.first[a]
        arc, at = spread(self.first[a], n), np.repeat(np.arange(len(a)), n)
        key = b[at] * self.n_labels + self.arc_label[arc]
        other = np.searchsorted(self.arc_key, key)
        hit = np.flatnonzero(self.arc_key[np.minimum(other, len(self.arc_key) - 1)] == key) if len(self.arc_key) else arc[:0]
        arc, other, at = arc[hit], other[hit], at[hit]
        back = swap[at]
        x, y = np.where(back, other, arc), np.where(back, arc, other)
        return self.arc_to[x], self.arc_to[y], i[at] + self.arc_skip[x], j[at] + self.arc_skip[y]

    def near_pairs(self):
        """Yields (i, j) arrays: words of one group that one edit turns into each other; insertions among equal letters come
        more than once."""
        q, i = self.starts, self.base.astype(np.int64)
        pairs = tuple(np.zeros(0, np.int64) for _ in range(4))
        while len(q) or len(pairs[0]):
            n = self.first[q + 1] - self.first[q]
            arc, at = spread(self.first[q], n), np.repeat(np.arange(len(q)), n)
            to, j = self.arc_to[arc], i[at] + self.arc_skip[arc]
            born = [pairs, (q[at], to, i[at], j)]  # a code point more in the second word
            left = np.repeat(self.first[q + 1], n) - arc - 1  # arcs of the same state after this one
            x = np.repeat(np.arange(len(arc)), left)
            y = spread(np.arange(len(arc)) + 1, left)
            replaced = (to[x], to[y], j[x], j[y])
            # advanced pairs and insertions are judged now, replaced ones as well: all have read their edit
            moved = self.advance(*pairs)
            pairs = tuple(np.concatenate(v) for v in zip(moved, born[1], replaced, strict=True))
            both = self.final[pairs[0]] & self.final[pairs[1]]
            if both.any():
                yield pairs[2][both], pairs[3][both]
            q, i = to, j


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (n[k] numbers) for every k."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return np.arange(total) - np.repeat(ends - n - first, n)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and the words' offsets."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), np.r_[0, np.cumsum(length)]


def common_prefix(codes: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of words i and j, up to limit."""
    end = np.minimum(np.minimum(offsets[i + 1] - offsets[i], offsets[j + 1] - offsets[j]), limit)
    out, alive = np.zeros(len(i), np.int64), np.flatnonzero(end > 0)
    d = 0
    while len(alive):
        same = codes[offsets[i[alive]] + d] == codes[offsets[j[alive]] + d]
        alive = alive[same]
        d += 1
        out[alive] = d
        alive = alive[end[alive] > d]
    return out


def bucket_neighbours(t: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best): near words of each word of a bucket's groups, counted, and the most frequent one."""
    t = t.sort_by([("key", "ascending"), ("path", "ascending")])
    key = t["key"].combine_chunks()
    fresh = np.ones(len(t), bool)
    fresh[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    path_codes, path_at = code_points(t["path"].combine_chunks())
    acceptor = Acceptor(np.cumsum(fresh) - 1, path_codes, path_at)
    words = t["word"].combine_chunks()
    codes, at = code_points(words)
    n = t["n"].to_numpy()
    hi = t["hi"].fill_null(-1).to_numpy()
    m = t["m"].fill_null(-1).to_numpy()
    length = np.diff(at)
    found = []
    for i, j in acceptor.near_pairs():
        pair = np.unique(np.minimum(i, j) * len(t) + np.maximum(i, j))
        i, j = pair // len(t), pair % len(t)
        ok = (m[i] < 0) | (np.minimum(length[i], length[j]) == m[i])
        place = common_prefix(codes, at, i, j, np.where(hi[i] < 0, 0, hi[i]))
        ok &= (hi[i] < 0) | (place < hi[i])
        found.append(pair[ok])
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    i, j = pair // max(len(t), 1), pair % max(len(t), 1)
    i, j = np.r_[i, j], np.r_[j, i]
    rank = pc.rank(words, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((rank[j], -n[j], rank[i]))
    i, j = i[order], j[order]
    head = np.ones(len(i), bool)
    head[1:] = rank[i[1:]] != rank[i[:-1]]
    where = np.flatnonzero(head)
    count = np.diff(np.r_[where, len(i)])
    return pa.table({"word": words.take(pa.array(i[where])), "n_near": pa.array(count, pa.int64()),
                     "best_n": pa.array(n[j[where]], pa.int64()), "best": words.take(pa.array(j[where]))})


def neighbours(words: DataFrame, group_words: int = GROUP_WORDS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (distinct word, n) that have a near one."""
    dealt = deal(words, group_words)
    chars = int(dealt.agg(F.sum(F.length("path") + 1)).first()[0] or 0)
    buckets = max(1, -(-chars // bucket_chars))

    def go(t: pa.Table) -> pa.Table:
        return bucket_neighbours(t)

    found = (dealt.select((F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("bucket"), "word", "n", "hi", "m", "key", "path")
             .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(go, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.down")).alias("best_n"), F.col("b.best").alias("best")))


# --- forms and roots --------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of forms (word, form): the end of the chain of forms, found by jumping twice as far each turn.

    A form is FACTOR times as frequent as its word, so that a chain is short and has no circle."""
    jump = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jump.join(further, "root", "left_semi").isEmpty():
            return jump
        jump = save(jump.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(words: DataFrame, factor: int = FACTOR, group_words: int = GROUP_WORDS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """words plus form, root, n_near, form_n.

    words: distinct word (string of at least ``MIN_CHARS`` code points), n (long).  form: the near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``factor`` times the word's n, else null.  root: the last of the chain of
    forms, the word itself without one.  No words: no rows.  A word of a million code points costs as many turns of the task
    that holds it.
    """
    words = save(words.select("word", "n"), "vocabulary")
    near = words.join(neighbours(words, group_words, bucket_chars), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    out = save(near.select("word", "n", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
                           F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "forms")
    root = roots(out.where("form is not null"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **limits) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs.

    docs: doc_id, text; other columns, whatever their names, play no part.  Null or empty texts have no words.  Rows without
    doc_id count as documents whose id is the empty string.  Repeated rows count as often as they stand.  A run of any length
    is one word.
    """
    return group_variants(count_words(docs.select("doc_id", "text")), **limits)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of the whole document texts."""
    return spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = f"""WITH t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
r AS (SELECT coalesce(CAST(doc_id AS varchar), '') AS id,
             unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z' || chr(192) || '-' || chr(255) || ']+')) AS run FROM documents),
p AS (SELECT run, count(*) AS n, id || ':' || run AS s, hex(encode(id || ':' || run)) AS hx FROM r WHERE length(run) >= {MIN_CHARS} GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(s)), lambda k:
         (instr('0123456789ABCDEF', substr(hx, CAST(2 * k + 1 AS INT), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, CAST(2 * k + 2 AS INT), 1)) - 1)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM p, t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest
      FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
e AS (SELECT DISTINCT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT DISTINCT d.word, w.word FROM d JOIN w ON d.rest = w.word
      UNION SELECT DISTINCT w.word, d.word FROM d JOIN w ON d.rest = w.word),
f AS (SELECT e.a AS word, count(*) AS n_near, max(w.n) AS best_n FROM e JOIN w ON w.word = e.b GROUP BY e.a),
g AS (SELECT f.word, f.n_near, f.best_n, min(e.b) AS best FROM f JOIN e ON e.a = f.word JOIN w ON w.word = e.b AND w.n = f.best_n GROUP BY ALL),
o AS MATERIALIZED (SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.best_n >= {FACTOR} * w.n THEN g.best END AS form,
      CASE WHEN g.best_n >= {FACTOR} * w.n THEN g.best_n END AS form_n FROM w LEFT JOIN g ON g.word = w.word),
c AS (SELECT word, word AS cur, form AS nxt, 0 AS step FROM o
      UNION ALL SELECT c.word, o.word, o.form, step + 1 FROM c JOIN o ON o.word = c.nxt),
l AS (SELECT word, arg_max(cur, step) AS root FROM c GROUP BY word)
SELECT o.word, o.form, l.root, o.n, o.n_near, o.form_n FROM o JOIN l ON l.word = o.word""".replace("WITH t AS", "WITH RECURSIVE t AS", 1)

QUERIES = {"op11_variants": op11_variants}
ORACLE = {"op11_variants": OP11_SQL}
