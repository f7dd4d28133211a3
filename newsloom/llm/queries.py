"""Queries over the corpus operators, as the entry module registers them."""

from __future__ import annotations

from . import codes, merkle, secrets, suffixes, warc
from .bpe import op4_bpe
from .codes import op11_codes
from .languages import op12_languages
from .media import op7_media
from .merkle import op13_merkle
from .packing import op6_packing
from .secrets import op1_secrets
from .simhash import op3_simhash
from .suffixes import op2_suffixes
from .token_counts import op10_token_counts
from .toxicity import op5_toxicity
from .warc import op8_warc
from .winnowing import op9_winnowing


def queries() -> dict:
    return {q.__name__: q for q in (op1_secrets, op2_suffixes, op3_simhash, op4_bpe, op5_toxicity, op6_packing, op7_media, op8_warc, op9_winnowing, op10_token_counts, op11_codes, op12_languages, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.SQL, "op2_suffixes": suffixes.SQL, "op8_warc": warc.SQL, "op11_codes": codes.SQL, "op13_merkle": merkle.SQL}
