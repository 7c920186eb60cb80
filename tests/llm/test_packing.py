import random

from pyspark.sql import functions as F

from langweave.llm.packing import CAPACITIES, best_fit_packing, pack_group, sequence_cost


def check_bins(rows, capacities):
    """Pieces of a bin lie one after the other, and its size is the smallest that holds them."""
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_used for r in members} == {at}
        assert {r.bin_size for r in members} == {min(c for c in capacities if c >= at)}
    return bins


def plain_best_fit(lengths, capacities):
    """The same rule, with a look at every open bin for every piece."""
    bins, left = [], sum(lengths)
    for length in lengths:
        open_bins = [(size - used, -k) for k, (size, used) in enumerate(bins) if size - used >= length]
        if open_bins:
            k = -min(open_bins)[1]
        else:
            fits = [c for c in capacities if c >= length]
            bins.append([min(fits, key=lambda c: (sequence_cost(c) / min(c // length * length, left), c)), 0])
            k = len(bins) - 1
        bins[k][1] += length
        left -= length
    return [used for _, used in bins]


def test_same_bins_as_a_plain_search():
    r = random.Random(0)
    for trial in range(30):
        lengths = sorted((r.randint(1, 8192 if trial % 2 else 600) for _ in range(r.randint(1, 200))), reverse=True)
        placed = pack_group(lengths)
        used = {}
        for number, _, _, contents in placed:
            used[number] = contents
        assert [used[k] for k in sorted(used)] == plain_best_fit(lengths, CAPACITIES)


def test_little_space_is_left():
    r = random.Random(1)
    lengths = sorted((min(8191, int(r.lognormvariate(6.5, 1))) + 1 for _ in range(20_000)), reverse=True)
    sizes = {number: (size, used) for number, _, size, used in pack_group(lengths)}
    assert sum(used for _, used in sizes.values()) == sum(lengths)
    assert sum(size for size, _ in sizes.values()) < 1.002 * sum(lengths)


def test_largest_only_where_it_pays():
    # Two pieces of 300 fit one sequence of 1024; a single one is left in the smallest.
    assert [size for _, _, size, _ in pack_group([300, 300])] == [1024, 1024]
    assert pack_group([300]) == [(0, 0, 512, 300)]
    assert pack_group([]) == []


def test_every_byte_of_every_document_is_packed_once(documents):
    frame, rows = documents
    got = best_fit_packing(frame, group_pieces=50).collect()
    check_bins(got, CAPACITIES)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for doc_id, text in rows:
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.piece):
            assert r.piece_start == at and 0 < r.n_tokens <= 8192
            at += r.n_tokens
        assert at == len(text.encode()) + 1
    assert len({r.bin_id.split("-")[0] for r in got}) > 1


def test_same_result_however_rows_are_dealt(documents):
    frame, _ = documents
    a = {tuple(r) for r in best_fit_packing(frame, group_pieces=70).collect()}
    b = {tuple(r) for r in best_fit_packing(frame.repartition(5, "text"), group_pieces=70).collect()}
    assert a == b


def group_sizes(rows):
    sizes = {}
    for r in rows:
        group = r.bin_id.split("-")[0]
        sizes[group] = sizes.get(group, 0) + 1
    return sizes


def test_no_group_grows_with_a_repeated_id_or_long_documents(spark):
    repeated = spark.range(3000).selectExpr("7L as doc_id", "30000 as n", "id % 2 as bin_offset")
    got = best_fit_packing(repeated, F.col("n"), group_pieces=1000).collect()
    check_bins(got, CAPACITIES)
    assert len(got) == 12_000 and max(group_sizes(got).values()) < 2000
    assert sum(r.n_tokens for r in got) == 3000 * 30_000
    long = spark.range(300).selectExpr("id as doc_id", "300000 as n")
    got = best_fit_packing(long, F.col("n"), group_pieces=1000).collect()
    check_bins(got, CAPACITIES)
    assert len(got) == 300 * 37 and max(group_sizes(got).values()) < 2000


def test_awkward_rows(awkward, make):
    got = best_fit_packing(awkward.selectExpr("*", "1 as bin_id", "2 as _tokens")).collect()
    check_bins(got, CAPACITIES)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.piece == 0) == sorted(
        (i is None, i or 0) for i in (0, 1, 2, 3, 3, 4, 5, 6, 7, None)
    )
    assert sum(r.n_tokens for r in got if r.doc_id == 5) == 150_001
    lengths = F.when(F.col("doc_id") == 0, F.lit(None)).when(F.col("doc_id") == 1, -5).otherwise(F.col("doc_id") - 2)
    assert [r.n_tokens for r in best_fit_packing(make(["x"] * 5), lengths).orderBy("doc_id").collect()] == [1, 2]
    assert best_fit_packing(awkward.limit(0)).collect() == []
