"""Languages with few documents."""

from inkspool.llm import langid

from .data import docs


def test_a_rare_language_is_a_class(spark):
    rows = [(i, f"the cat and the dog went to the house number {i}" if i % 2 else f"der hund und die katze gingen zum haus nummer {i}", "en" if i % 2 else "de", "s") for i in range(3000)]
    rows += [(10_000 + i, f"żółw i jeż poszli do lasu numer {i}", "pl", "s") for i in range(3)]
    net = langid.train(docs(spark, rows), train_docs=100)
    assert net.langs == ["de", "en", "pl"]
