import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from saiflow.llm import packing
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            bins, room = bins + 1, capacity
        else:
            room = rooms.pop(k)
        if room > n:
            bisect.insort(rooms, room - n)
    return bins


def test_histogram_packing_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.randint(1, 70)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        count = Counter(lengths)
        plan = packing.best_fit_decreasing(count, capacity)
        n = np.repeat(list(count), list(count.values()))
        rank = np.concatenate([np.arange(c) for c in count.values()])
        bins, offset = plan.place(n, rank)
        filled = defaultdict(list)
        for b, o, k in zip(bins.tolist(), offset.tolist(), n.tolist()):
            filled[b].append((o, k))
        for own in filled.values():
            end = 0
            for o, k in sorted(own):
                assert o == end
                end += k
            assert end <= capacity
        assert len(filled) == plan.bins == plain_best_fit(lengths, capacity)
    assert packing.best_fit_decreasing({}, 5).bins == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB,.'sΣσİé́ \n\t\x1c1ñ한-!?’<|>"), max_size=14))
def test_cached_ids_are_the_librarys(text):
    tok = packing.word_tokenizer(FILE)
    got = np.frombuffer(next(iter(tok.encode([text]))), "<u4").tolist()
    assert got == tok.tok.encode(text, add_special_tokens=False).ids


def test_edge_rows(spark, edge_docs, edge_rows):
    got = packing.pack(spark, edge_docs, FILE, capacity=512).collect()
    tok, want = Tokenizer.from_file(FILE), []
    for r in edge_rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 512)):
            own = ids[start:start + 512]
            want.append((str(r[0]), piece, start, len(own), zlib.crc32(own.tobytes()), tuple(own.tolist())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] != "None")
    slim = packing.pack(spark, edge_docs, FILE, capacity=512, with_ids=False).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in slim) == sorted(w[:5] for w in want)
    filled = defaultdict(list)
    for r in slim:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 512
    assert len(filled) == plain_best_fit([w[3] for w in want], 512)


def test_rows_without_id_keep_their_ids(spark, edge_docs, edge_rows):
    more = [(None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    docs = edge_docs.union(spark.createDataFrame(more, edge_docs.schema))
    tok, want = Tokenizer.from_file(FILE), []
    for r in edge_rows + more:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want += [(str(r[0]), k, tuple(ids[at:at + 512])) for k, at in enumerate(range(0, len(ids), 512))]
    got = packing.pack(spark, docs, FILE, capacity=512).collect()
    assert sorted((str(r.doc_id), r.piece, tuple(r.ids)) for r in got) == sorted(want)
    end = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end[r.sequence_id] and r.length == len(r.ids)
        end[r.sequence_id] += r.length


def test_empty_table(spark, no_docs):
    assert packing.pack(spark, no_docs, FILE).count() == 0


def test_rows_without_id_have_ranks_of_their_own(spark):
    rows = [(None, k, 0, 0, 5, 77) for k in range(40)] + [(1, 50, 0, 0, 5, 77)]
    pieces = spark.createDataFrame(rows, "doc_id long, row long, piece int, start long, length long, ids_crc32 long").repartition(4)
    ranked = packing.rank_within(pieces, 3)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(41))
    own = [e for e in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in e]
    assert own and "row#" in own[0].split("windowspecdefinition")[1]
