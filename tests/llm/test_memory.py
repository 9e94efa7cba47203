import pyarrow as pa
import pytest

from lumenlex import shared
from lumenlex.llm import langid, neardup, packing


@pytest.fixture
def given(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    return calls


def test_a_pass_gives_back_at_its_end(given):
    run = shared.giving_back(lambda batches: (b + 1 for b in batches))
    passed = run(iter([1, 2]))
    assert next(passed) == 2 and not given
    assert list(passed) == [3] and len(given) == 1
    passed = run(iter([1, 2]))
    next(passed)
    passed.close()
    assert len(given) == 2
    with pytest.raises(TypeError):
        list(run(iter([None])))
    assert len(given) == 3


def test_free_memory_of_arrow_can_be_given_back():
    held = pa.array(range(100_000))
    shared.give_back()
    assert held[-1].as_py() == 99_999


def test_passes_over_texts_give_back(docs_of, monkeypatch):
    """Every pass over whole texts of the pipeline is wrapped."""
    wrapped, plain = [], shared.giving_back
    for module in (langid, neardup, packing):
        monkeypatch.setattr(module, "giving_back", lambda run, module=module: wrapped.append(module) or plain(run))
    docs = docs_of([(i, f"one two three four five six seven {i % 3}", "en") for i in range(12)])
    assert langid.keep_identified(docs).count() == 12
    assert neardup.signatures(docs, 5, 4, 2, 64, 1).count() == neardup.shingle_sets(docs, 5).count() == 12
    assert packing.pack(docs).count() > 0
    assert wrapped.count(langid) == 3 and wrapped.count(neardup) == 2 and wrapped.count(packing) == 1
