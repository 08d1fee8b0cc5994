from collections import defaultdict
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from larkspur.llm import queries
from larkspur.llm.bpe import tokenizer_file
from larkspur.session import table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables here")
def test_p6_lengths(spark):
    public = Tokenizer.from_str(tokenizer_file("byte_bpe_50k")[0].decode())
    public.encode_special_tokens = True
    n = defaultdict(list)
    for r in table(spark, SMALL, "documents").collect():
        n[r.source].append(len(public.encode(r.text, add_special_tokens=False).ids) if r.text else 0)
    got = {r.source: (r.n_docs, r.n_tokens, r.most_tokens) for r in queries.p6_lengths(spark, SMALL).collect()}
    assert got == {s: (len(x), sum(x), max(x)) for s, x in n.items()}
