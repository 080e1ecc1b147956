import pytest

from ripplegraph.llm import common
from ripplegraph.llm.exact_dedup import exact_duplicates, kept_rows
from ripplegraph.llm.simhash import near_duplicates

HOT = "the one text that half of all rows hold, word for word"


@pytest.fixture(scope="module")
def half(spark):
    """Half of the rows hold one text; of the others, each text has two rows."""
    return spark.range(3000).selectExpr("id AS doc_id", f"if(id % 2 = 0, '{HOT}', concat_ws(' ', transform(sequence(1, 30), k -> sha1(concat(k, '-', id div 4))))) AS text").repartition(8)


def test_only_common_keys_are_sent_to_the_rows(spark, half, monkeypatch):
    sent = []
    plain = common.F.broadcast
    monkeypatch.setattr(common.F, "broadcast", lambda df: sent.append(df.count()) or plain(df))
    rows = exact_duplicates(half).collect()
    assert 2 in sent, "the common text, once for the snapshot and once for the batch"
    by = {r.doc_id: r for r in rows}
    assert len(by) == 3000
    for i, r in by.items():
        keep, size = (2998, 1500) if i % 2 == 0 else (i // 4 * 4 + 3, 2)
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, i == keep)
    assert kept_rows(half).count() == 751


def test_components_of_a_common_text(half):
    rows = {r.doc_id: r.component_id for r in near_duplicates(half).collect()}
    assert rows == {i: 0 if i % 2 == 0 else i // 4 * 4 + 1 for i in range(3000)}
