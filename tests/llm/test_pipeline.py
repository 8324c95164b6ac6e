import collections
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lettermill.llm import bpe, toxicity
from lettermill.llm.work import kept

from .helpers import documents, words
from .test_copies import shingle_set


def rows(frame):
    """(id, text) of all rows, each as often as it is there."""
    return collections.Counter((str(r[0]), r[1]) for r in frame.select("doc_id", "text").collect())


def classes(texts):
    """For each text the least number of a text that Jaccard links join it to."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and top(i) != top(j) and len(a & b) >= 0.8 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def in_order(frame):
    """Rows by id, those without one last; of equal ids in the order of their texts."""
    return sorted((tuple(r) for r in frame.select("doc_id", "text", "source").collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))


def without_repeated_lines(held):
    """What the line stage leaves of rows (id, text, site) in order."""
    tops = classes([t for _, t, _ in held])
    site = {}
    for (_, _, s), c in zip(held, tops):
        if s is not None:
            site.setdefault(c, s)
    seen = collections.defaultdict(set)
    for (_, t, _), c in zip(held, tops):
        for line in (t or "").split("\n"):
            if line.strip(" \t\r"):
                seen[line.strip(" ")].add(c)
    out = []
    for (i, t, _), c in zip(held, tops):
        left = []
        for line in (t or "").split("\n"):
            own = seen.get(line.strip(" "), set()) if line.strip(" \t\r") else set()
            spread = len({site[x] for x in own if x in site}) >= 5
            repeated = len(own) > 1 and len(line.split()) >= 50 and min(own) != c
            if not spread and not repeated:
                left.append(line)
        out.append((str(i), None if t is None else "\n".join(left)))
    return collections.Counter(out)


def contaminated(text, phrases):
    w, hit = words(text), set()
    for m in {len(p) for p in phrases}:
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in phrases:
                hit |= {*range(i, i + m)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_against_brute_force(spark, small):
    docs = documents(spark, small).selectExpr("*", "5 as gone", "6 as n_lines", "7 as n_removed", "8 as `a.b`", "9 as key", "'t' as site")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.scored(docs, model, keep=["doc_id", "text"])
    want = rows(scored.where("score < 0.5"))
    after = kept(stages["toxicity"](spark, docs, small), "one")
    assert rows(after) == want and after.columns == columns

    want = without_repeated_lines(in_order(after))
    docs, after = after, kept(stages["line_dedup"](spark, after, small), "two")
    assert rows(after) == want and after.columns == columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["n_lines"] == 6 for r in after.collect())

    held = in_order(after)
    tops = classes([t for _, t, _ in held])
    want = collections.Counter((str(i), t) for k, (i, t, _) in enumerate(held) if tops[k] == k or not words(t))
    docs, after = after, kept(stages["ngram_jaccard_join"](spark, after, small), "three")
    assert rows(after) == want and after.columns == columns

    phrases = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(r["text"])
        m = min(13, len(w))
        phrases |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1 if m else 0)}
    want = collections.Counter({k: n for k, n in rows(after).items() if not contaminated(k[1], phrases)})
    docs, after = after, kept(stages["benchmark_decontamination"](spark, after, small), "four")
    assert rows(after) == want and after.columns == columns

    out = stages["byte_level_bpe"](spark, after, small).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    want = sorted((str(r["doc_id"]), len(i := library.encode_ordinary(r["text"] or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r in after.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in out) == want


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0, name
        assert name == "byte_level_bpe" or out.columns == docs.columns


def test_run(spark, small):
    found = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(found) < spark.read.parquet(f"{small}/documents.parquet").count() and len({r["doc_id"] for r in found}) == len(found)
    assert words("aB, c") == ["ab", "c"]
