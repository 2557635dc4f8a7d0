"""The queries of this subpackage, by name."""

from .ann import op4_ann
from .bpe import op3_bpe
from .chat import op5_chat
from .html_extract import op8_html
from .merkle import op1_merkle
from .mixing import op2_mixing
from .ngram_join import op9_ngram_join
from .sharding import op6_sharding
from .toxicity import op7_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_merkle, op2_mixing, op3_bpe, op4_ann, op5_chat, op6_sharding, op7_toxicity, op8_html, op9_ngram_join, op10_warc)}
#: None of the ten can be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
