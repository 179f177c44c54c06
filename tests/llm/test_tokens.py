import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
import pyarrow as pa

from creditweave.llm.tokens import count_tokens, token_counts
from tests.llm.corpus import documents, numbered, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def whole(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False))


def test_counts_equal_the_library_on_whole_texts(spark):
    values = texts()
    got = {r.doc_id: r for r in token_counts(numbered(spark, values), PATH).collect()}
    for i, text in enumerate(values):
        assert got[i].n_tokens == whole(text)
        assert got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (whole(text) > 2048)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), min_size=1, max_size=4))
def test_any_text(values):
    assert count_tokens(PATH, pa.array(values)).tolist() == [whole(v) for v in values]


def test_empty_table_extra_and_clashing_columns(spark):
    empty = token_counts(documents(spark, [], "n_tokens string, note string"), PATH)
    assert empty.columns == ["doc_id", "text", "n_tokens", "note", "n_bytes", "over_limit"]
    assert empty.count() == 0
    one = token_counts(documents(spark, [(None, "a b", "old", "kept")], "n_tokens string, note string"), PATH).first()
    assert (one.doc_id, one.n_tokens, one.note) == (None, 2, "kept")
