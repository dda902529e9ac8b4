import pyarrow as pa

from siltstone.plans.streams import slices


def test_texts_come_in_slices():
    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * 4, None, "é" * 3, "b" * 50, "", "c" * 5, "d" * 5])], ["k", "t"])
    got = list(slices(iter([batch, batch.slice(0, 0)]), "t", most=10))
    assert [r["k"].to_pylist() for r in got] == [[0, 1, 2], [3], [4, 5, 6], []]
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist()


def test_a_worker_takes_one_slice_of_a_batch_at_a_time():
    taken = []
    batch = pa.record_batch([pa.array(["x" * 1_000_000] * 10)], ["t"])
    for part in slices(iter([batch]), "t"):
        taken.append(part.num_rows)
    assert taken == [2] * 5
