"""Only tokens that end at a prefix are tried as its last one."""

from tokenizers import Tokenizer

from nearmiss.llm.common import tokenizer_path
from nearmiss.llm.token_counts import PrefixCounter


def test_prefixes_are_counted_without_looking_up_every_part():
    path = tokenizer_path("byte_bpe_50k.json")
    counter, library = PrefixCounter(path), Tokenizer.from_file(path)
    for begun in (b"ing", b" the", b"\xc3"):
        found = counter.ending[counter.states[begun]]
        assert found == tuple((len(begun) - i, counter.ids[begun[i:]]) for i in range(len(begun)) if begun[i:] in counter.ids)
    counter.ids = None  # not needed any more
    for piece in ("unverfänglichkeitsprüfung", " zqxjkvbwpy", "internationalization", "=" * 70, "漢字かな交じり文", "ñandú"):
        assert counter.piece(piece) == [len(library.encode(piece[:i + 1], add_special_tokens=False).ids) for i in range(len(piece))]
