"""Line dedup, SimHash and quality rules against SQL and brute force."""

import pathlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import same_rows

xxhash = pytest.importorskip("xxhash")

from veldra.llm import line_dedup, quality_rules, queries, simhash  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, where):
    same_rows(queries.QUERIES[name](spark, where), queries.SQL[name], where)


# Line dedup


def deduped(docs, **settings):
    return {r.row.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs, **settings).collect()}


def test_templates_with_variable_fields(spark, docs_of):
    logs = [f"user {name} logged in at node {100 + i}" for i, name in enumerate("ann bob cid dan eve fay".split())]
    rows = deduped(docs_of([f"own text of document {i} here\n{line}" for i, line in enumerate(logs)]), min_docs=5)
    assert rows[0][0].endswith(logs[0]) and rows[0][2] == 0
    assert all(rows[i] == (f"own text of document {i} here", 2, 1) for i in range(1, 6)) or all(rows[i][2] >= 1 for i in range(1, 6))


def test_words_that_differ_become_variable(spark, docs_of):
    names = "ann bob cid dan eve fay".split()
    rows = deduped(docs_of([f"the report for {n} was sent\nzeta {n} alone {n}" for n in names]), min_docs=5)
    assert rows[0][2] == 0 and all(rows[i] == (f"zeta {names[i]} alone {names[i]}", 2, 1) for i in range(1, 6))


def varied(spark, lines, templates, depth=3, similarity=0.6):
    """Lines (owner, leaf, text) that ``variant_lines`` drops, given templates (first owner, leaf, {place: word})."""
    from veldra.session import Scratch

    owner = "struct<doc_id:long,hash:long>"
    made = spark.createDataFrame([((o, 0), i, leaf, len(m.split(" ")), m) for i, (o, leaf, m) in enumerate(lines)], f"owner {owner}, place int, leaf long, fields int, m string")
    flat = [(t, leaf, (f, 0), n, at, w) for t, (f, leaf, n, words) in enumerate(templates) for at, w in words.items()]
    with Scratch(spark) as work:
        rows = spark.createDataFrame(flat, f"template long, leaf long, first {owner}, fields int, at int, field string").withColumn("field", F.xxhash64("field"))
        return {r.place for r in line_dedup.variant_lines(work, made, rows, depth, similarity, 1000).collect()}


def test_a_line_meets_every_template_of_its_leaf(spark):
    line = "a b c d e f g h x y z q w".split()  # agrees with the second template in 6 of 10 fields after the leading ones
    second = dict(enumerate("a b c d e f g h x 1 2 3 4".split()))
    first = {i: w for i, w in enumerate("a b c 9 9 9 9 8 8 y z q w".split())}
    assert varied(spark, [(1, 5, " ".join(line))], [(7, 5, 13, second)]) == {0}
    assert varied(spark, [(1, 5, " ".join(line))], [(6, 5, 13, first), (7, 5, 13, second)]) == {0}
    assert varied(spark, [(7, 5, " ".join(line))], [(6, 5, 13, first), (7, 5, 13, second)]) == set()


@pytest.mark.parametrize("seed", range(4))
def test_variants_equal_brute_force(spark, seed):
    chance = random.Random(seed)
    word = lambda: chance.choice("pqrst")
    width = {0: 8, 1: 13, 2: 4}
    make = lambda leaf: ["a", "b", "c", *(word() for _ in range(width[leaf] - 3))]
    templates = []
    for _ in range(40):
        leaf = chance.randrange(3)
        templates.append((chance.randrange(4), leaf, width[leaf], {i: w for i, w in enumerate(make(leaf)) if i < 3 or chance.random() < 0.8}))
    lines = [(chance.randrange(4), leaf, " ".join(make(leaf))) for leaf in (chance.randrange(3) for _ in range(300))]

    def hit(owner, leaf, text):
        words, need = text.split(" "), max(1, -(-6 * (width[leaf] - 3) // 10))
        return any(f != owner and at == leaf and sum(words[i] == w for i, w in held.items() if i >= 3) >= need for f, at, _, held in templates)

    want = {i for i, x in enumerate(lines) if hit(*x)}
    assert varied(spark, lines, templates) == want and 0 < len(want) < len(lines)


#: All steps of ``line_dedup`` as it is by default, variants of templates too; ``OP6_SQL`` has none.
WHOLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, unnest(range(0, len(string_split(t, chr(10))))) AS place FROM d),
p AS (SELECT doc_id, place, trim(translate(s, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS s FROM l),
m AS (SELECT doc_id, place, list_transform(string_split(s, ' '), lambda f: CASE WHEN regexp_matches(f, '[0-9]') THEN '<*>' ELSE f END) AS fs FROM p),
f AS (SELECT doc_id, place, fs, len(fs) AS nf, fs[1:3] AS lead, greatest(1, ceil(0.6 * (len(fs) - 3))) AS least FROM m WHERE len(fs) >= 3),
ex AS (SELECT fs, nf, lead, min(doc_id) AS first FROM f GROUP BY fs, nf, lead HAVING count(DISTINCT doc_id) >= 5),
leaf AS (SELECT nf, lead FROM f GROUP BY nf, lead HAVING count(DISTINCT doc_id) >= 5),
loose AS (SELECT f.* FROM f SEMI JOIN leaf USING (nf, lead) ANTI JOIN ex USING (fs)),
fl AS (SELECT doc_id, place, nf, lead, least, unnest(fs) AS field, unnest(range(0, nf)) AS nth FROM loose),
co AS (SELECT nf, lead, nth, field FROM fl GROUP BY nf, lead, nth, field HAVING count(DISTINCT doc_id) >= 5),
sh AS (SELECT doc_id, place, nf, lead, list((nth, field) ORDER BY nth) AS c FROM fl JOIN co USING (nf, lead, nth, field) GROUP BY doc_id, place, nf, lead, least HAVING count(*) FILTER (WHERE nth >= 3) >= least),
ge AS (SELECT nf, lead, c, min(doc_id) AS first FROM sh GROUP BY nf, lead, c HAVING count(DISTINCT doc_id) >= 5),
te AS (SELECT row_number() OVER () AS id, * FROM (SELECT nf, lead, first, list_zip(range(0, nf), fs) AS c FROM ex UNION ALL SELECT nf, lead, first, c FROM ge)),
tf AS (SELECT id, nf, lead, first, unnest(c)[1] AS nth, unnest(c)[2] AS field FROM te),
rest AS (SELECT fl.* FROM fl ANTI JOIN (SELECT doc_id, place FROM sh SEMI JOIN ge USING (nf, lead, c)) USING (doc_id, place)),
va AS (SELECT doc_id, place FROM rest JOIN tf USING (nf, lead, nth, field) WHERE nth >= 3 AND doc_id <> first GROUP BY doc_id, place, id, least HAVING count(*) >= least),
gone AS (SELECT doc_id, place FROM f JOIN ex USING (fs) WHERE doc_id <> first UNION SELECT doc_id, place FROM sh JOIN ge USING (nf, lead, c) WHERE doc_id <> first UNION SELECT doc_id, place FROM va),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_dropped, coalesce(string_agg(l.s, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text
      FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, text FROM k
"""


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_all_steps_equal_sql(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text")
    same_rows(line_dedup.line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped", "text"), WHOLE_SQL, where)


def test_only_templates_that_a_pattern_may_meet_are_shuffled(spark):
    sc = spark.sparkContext
    jvm = sc._jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        rows = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {rows.apply(i).stageId(): rows.apply(i).shuffleWriteBytes() for i in range(rows.size())}

    chance = random.Random(3)
    word = lambda: f"w{chance.getrandbits(40):x}"
    templates = [(i, 5, 103, dict(enumerate(["a", "b", "c", *(word() for _ in range(100))]))) for i in range(200)]
    near = lambda at, n: " ".join(w if k < 3 + n else "other" for k, w in templates[at][3].items())
    lines = [(7, 5, near(7, 80)), (8, 5, near(9, 80)), (9, 5, near(12, 5))]  # of its own first document; a variant; too few fields
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    kept = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        last = max(stages(), default=-1)
        assert varied(spark, lines, templates, similarity=0.1) == {1}
        written = sum(b for k, b in stages().items() if k > last)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert written < 200 * 91 * 100 * 8 / 2  # half of all constants, once for each of their template's 91 rare keys


def test_rare_and_short_lines_stay(spark, docs_of):
    texts = [f"Yes.\nshared by four only\nunique words number {chr(97 + i) * 3} {chr(97 + i)}q {chr(98 + i)}w" if i < 4 else f"Yes.\nalone {chr(97 + i)} and {chr(98 + i)}" for i in range(8)]
    rows = deduped(docs_of(texts), min_docs=5)
    assert all(rows[i][0] == texts[i] for i in range(8))


def test_line_edge_cases(spark, docs_of):
    line = "a line that all of them have"
    long = "\n".join(f"row {chr(97 + i % 26)}{i // 26 * 'z'} is its own" for i in range(3000))
    rows = deduped(docs_of([(5, line), (3, line), (3, line), (4, f"{line}\n{line}\n"), (None, line), (7, None), (8, ""), (9, long)]), min_docs=3)
    assert rows[None][0] == line  # a null id comes first, and so keeps its line
    assert rows[5] == rows[3] == ("", 1, 1) and rows[4] == ("", 3, 2)
    assert rows[7] == rows[8] == ("", 1, 0) and rows[9][0] == long
    assert line_dedup.line_dedup(docs_of([line]).where("false")).count() == 0


def test_joins_beyond_the_broadcast_bound(spark, docs_of):
    docs = docs_of([f"one two three four five {n}\nthe same line everywhere" for n in "abcdefgh"])
    assert deduped(docs) == deduped(docs, broadcast_hashes=0)


def test_variants_of_a_template_go_with_it(spark, docs_of):
    passage = "the quick report of this week was sent to all of the members by post"
    near, far = passage.replace("members", "readers"), "the quick report that nobody ever saw has been lost on its way home again"
    general = [f"we are glad that {n} could come to this great event" for n in "ann bob cid dan eve fay".split()]
    alone = "we are glad that gus could come to this small event"
    texts = [f"{passage}\n{general[i]}" for i in range(6)] + [near, alone, far]
    for settings in ({}, {"broadcast_hashes": 0}):
        rows = deduped(docs_of(texts), **settings)
        assert rows[0] == (texts[0], 2, 0) and all(rows[i][2] == 2 for i in range(1, 6))
        assert rows[6] == rows[7] == ("", 1, 1) and rows[8] == (far, 1, 0)
        assert deduped(docs_of(texts), variants=False, **settings)[6] == (near, 1, 0)
    first = deduped(docs_of([f"{passage}\n{near}", *[passage] * 5]))
    assert first[0] == (f"{passage}\n{near}", 2, 0)  # the template's own first document


def test_a_common_opening_is_no_template(spark, docs_of):
    ends = "day night trip book film game song walk talk meal".split()
    texts = [f"It was a {kind} {end}." if i % 2 else f"Here is the {end}" for i, (kind, end) in enumerate(zip(["good", "bad", "long", "odd", "new"] * 2, ends))]
    texts += [f"it was a good {end}" for end in ends]
    rows = deduped(docs_of(texts), min_docs=5)
    assert all(rows[i] == (t, 1, 0) for i, t in enumerate(texts))
    assert sum(n for _, _, n in deduped(docs_of(texts), min_docs=5, variants=False, whole_line=True).values()) > 0


# SimHash


def brute(rows):
    """(fingerprints, components) of (id, text) rows."""
    fps = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return fps, components([i for i, _ in rows], fps)


def components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    own = [find(i) for i in range(len(ids))]
    least = {}
    for r, i in zip(own, ids):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in own]


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    fps, own = brute(list(zip(docs.doc_id.tolist(), docs.text)))
    rows = queries.op9_simhash(spark, sf_dir).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert rows.fingerprint.tolist() == [f"{x:016x}" for x in fps] and rows.component_id.tolist() == own


def test_simhash_edge_cases(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(200))
    texts = [(9, base), (4, base + " tail"), (4, base + " tail"), (None, base.upper()), (12, None), (2, ""), (30, "\t \n"), (7, "One two"), (8, "one  TWO"), (11, "x" * 50_000), (None, "alone as can be"), (13, "ÀÉ à é")]
    got = sorted(((r.doc_id, simhash_hex(r.fp), r.component_id) for r in simhash.simhash_components(docs_of(texts)).collect()), key=str)
    fps, own = brute(texts)
    assert got == sorted(((i, f"{x:016x}", c) for (i, _), x, c in zip(texts, fps, own)), key=str)
    assert simhash.simhash_components(docs_of(["x"]).where("false")).count() == 0


def simhash_hex(fp):
    return f"{fp & (1 << 64) - 1:016x}"


@pytest.mark.parametrize("bucket", [2, 8, 1024])
@pytest.mark.parametrize("skewed", [False, True])
def test_star_edges_keep_all_links(spark, bucket, skewed):
    rnd = random.Random(bucket + skewed)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds[:20]:
        for _ in range(10):
            x = s
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(6 if skewed else 64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.star_edges(spark, distinct, 2, bucket)
    found = {r.node: r.root for r in simhash.components(spark, edges).collect()}
    got = [found.get(x, x) for x in signed]
    want = components(list(range(len(fps))), fps)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_are_a_pigeonhole(spark, radius):
    rnd = random.Random(radius)
    rows = [rnd.getrandbits(64) for _ in range(300)]
    masks = simhash.plan_masks(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in rows], "fp long"), radius)
    for _ in range(3000):
        gone = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, radius)))
        assert any(not gone & m for m in masks)


def test_allocation_is_the_best():
    rnd = random.Random(1)
    costs = [{t: rnd.random() for t in (-1, 0, 1, 2)} for _ in range(3)]
    import itertools

    want = min((sum(c[t] for c, t in zip(costs, ts)), list(ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=3) if sum(ts) == 0)
    got = simhash.allocate(costs, 0)
    assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def test_correlated_bits_share_a_part():
    rnd = np.random.default_rng(2)
    bits = rnd.random((4000, 64)) < 0.5
    bits[:, 40] = bits[:, 3]
    bits[:, 50] = bits[:, 3]
    both = bits.T.astype(float) @ bits
    groups = simhash.group_bits(both, 4000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 40, 50} <= set(g) for g in groups)


def test_chains_are_one_component(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)]
    random.Random(0).shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in simhash.components(spark, edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 301: 300}


def test_one_of_each(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(200))
    docs = docs_of([(9, base), (4, base), (4, base), (4, "another text of id four"), (None, base), (None, "no id here at all"), (1, ""), (2, None)])
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(4, base), (4, "another text of id four"), (None, "no id here at all"), (1, "")], key=str)


# Quality rules


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


RULED = [None, "", " \t\n", "a b c", "x\n\nx\n x\nx", "one two three four five six seven eight " * 2, "w " * 30, "a a a a a a a a a b", "é # $ ünï <tag> 中", " ".join(f"v{i}" for i in range(50)), " ".join(f"v{i % 25}" for i in range(60)), "r s t u v w x y z " * 300, "tab\x0bfeed\x0cx\ry"]


def test_measures(spark, docs_of):
    rows = quality_rules.quality_rules(docs_of([*RULED, RULED[4]]), keep=["doc_id"]).collect()
    assert len(rows) == len(RULED) + 1
    for r in rows:
        want = measures([*RULED, RULED[4]][r.row.doc_id])
        b = r.base
        assert (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words) == want
        assert b.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (b.base_failed and r.kept)


def test_hosts_are_shrunk_to_the_prior(spark, docs_of):
    good, bad = " ".join(f"v{i}" for i in range(30)), "short"
    rows = [(i, bad if i % 10 else good, "rotten") for i in range(400)] + [(1000 + i, good, f"fine{i % 20}") for i in range(400)] + [(2000, good, None), (2001, bad, None), (3000, good, "tiny")]
    found = quality_rules.quality_rules(docs_of(rows), keep=["doc_id", "source"])
    kept = {r.row.doc_id: (r.kept, r.host_rate) for r in found.collect()}
    assert len(kept) == len(rows)
    assert not any(kept[i][0] for i in range(400)) and all(kept[1000 + i][0] for i in range(400)) and kept[3000][0]
    assert 0 < kept[3000][1] < 0.5 < kept[0][1] < 0.9
    shuffled = {r.row.doc_id: r.kept for r in quality_rules.quality_rules(docs_of(rows), keep=["doc_id"], broadcast_hosts=0).collect()}
    assert shuffled == {i: k for i, (k, _) in kept.items()}


def test_one_host_and_no_rows(spark, docs_of):
    docs = docs_of(["short", " ".join(f"v{i}" for i in range(30))])
    assert {r.row.doc_id: r.kept for r in quality_rules.quality_rules(docs, max_host_rate=0.6).collect()} == {0: False, 1: True}
    assert quality_rules.quality_rules(docs.where("false")).count() == 0


def sql_rows(rows, sql):
    """What the SQL gives for (doc_id, text) rows of ``documents``."""
    import duckdb

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    return {d: (text, n, dropped) for d, n, dropped, text in duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({sql})").fetchall()}


@pytest.mark.parametrize("settings", [{}, {"broadcast_hashes": 0}, {"broadcast_hashes": 1}])
def test_copies_of_a_document_count_once(spark, docs_of, settings):
    line, other = "the line that all of them have in common", "one more line for {} of these people"
    shared = [(i, f"own words of document {i} {chr(97 + i) * 4}\n{line}\n{other.format(chr(97 + i))}") for i in range(6)]
    few = [(20 + i, f"held by two documents only my friend\nrow {chr(97 + i)} of it") for i in range(2)]
    rows = [*shared, *few]
    repeated = [*rows, *[few[0]] * 4, *[shared[2]] * 3]
    want = sql_rows(rows, queries.OP6_SQL)
    found = line_dedup.line_dedup(docs_of(repeated), variants=False, whole_line=True, **settings).collect()
    assert len(found) == len(repeated) and want[20][2] == want[21][2] == 0 < want[2][2]
    assert all((r.text, r.n_lines, r.n_dropped) == want[r.row.doc_id] for r in found)
    again = line_dedup.line_dedup(docs_of(repeated), **settings).collect()
    assert {r.row.doc_id: r.n_dropped for r in again if r.row.doc_id >= 20} == {20: 0, 21: 0}


def test_only_what_the_result_reads_is_left(spark, docs_of):
    from veldra import session

    root = pathlib.Path(session.checkpoint_root(spark))
    before = set(root.iterdir())
    rows = simhash.simhash_components(docs_of([f"text number {i} of them" for i in range(30)]))
    assert rows.count() == 30
    assert sorted(p.name.split("-")[0] for p in set(root.iterdir()) - before) == ["classes", "fingerprints"]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 11])
def test_repeated_words_of_any_width(spark, docs_of, width):
    rnd = random.Random(width)
    texts = [" ".join(rnd.choices("ab" if i % 2 else "abcdefgh", k=rnd.randint(0, 40))) for i in range(60)]
    rows = docs_of(texts).select("doc_id", quality_rules.repeated_words(quality_rules.words_of(F.col("text")), width).alias("n")).collect()

    def brute_force(words):
        windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(width)})

    assert {r.doc_id: r.n for r in rows} == {i: brute_force(t.split()) for i, t in enumerate(texts)}
