"""What a Python worker holds during a task, and after it."""

import public_tokenizers
from offerloom.llm import bpe, jaccard
from offerloom.llm.catalog import VOCABULARY
from offerloom.llm.common import map_texts


def test_frequent_tokens_are_dealt_out_over_the_texts():
    texts = [f"{' '.join(f'w{i}' for i in range(200))} own{k} text" for k in range(20)]
    made = jaccard._describe(texts)
    lengths = [len(v) for v in made["often"]]
    assert sum(lengths) == 196 and max(lengths) <= 10
    assert [len(v) for v in made["times"]] == lengths
    assert {int(n) for v in made["times"] for n in v} == {20}


def test_a_task_ends_with_its_clean_up(spark, tmp_path):
    frame = spark.range(10, numPartitions=2).selectExpr("id", "cast(id as string) as text")

    def end():
        (tmp_path / f"{len(list(tmp_path.iterdir()))}").touch()

    for _ in range(2):
        found = map_texts(frame.coalesce(1), lambda texts: {"n": [len(t) for t in texts]}, "n bigint", at_end=end).collect()
        assert len(found) == 10
    assert len(list(tmp_path.iterdir())) == 2


def test_pieces_are_forgotten():
    known = bpe.Vocabulary(public_tokenizers.path(VOCABULARY))
    first = list(known.digests(["some words of a text"]))
    assert known._known
    known.forget()
    assert not known._known and list(known.digests(["some words of a text"])) == first


def test_a_worker_gets_few_texts_at_a_time(spark):
    frame = spark.range(3000, numPartitions=1).selectExpr("id", "cast(id as string) as text")
    found = map_texts(frame, lambda texts: {"n": [len(texts)] * len(texts)}, "n bigint", at_once=1 << 20)
    assert found.agg({"n": "max"}).first()[0] <= 512
