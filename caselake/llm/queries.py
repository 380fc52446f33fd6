"""The registered queries of this package and their SQL."""

from __future__ import annotations

from .audio import op10_audio_features
from .byte_bpe import op8_byte_bpe
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .lexical import OP12_SQL, op12_lexical_search
from .licenses import OP4_SQL, op4_license_scan
from .line_dedup import op9_line_dedup
from .mixing import op2_mixing
from .nearest import op13_nearest_neighbours
from .quality import op3_quality
from .rotation_codes import op7_embedding_neardup
from .simhash import op1_simhash_neardup
from .toxicity import op6_toxicity
from .warc_zip import op5_warc_zip

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_neardup, op2_mixing, op3_quality, op4_license_scan, op5_warc_zip, op6_toxicity, op7_embedding_neardup, op8_byte_bpe, op9_line_dedup, op10_audio_features,
        op11_hard_negatives, op12_lexical_search, op13_nearest_neighbours,
    )
}
SQL = {"op4_license_scan": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_lexical_search": OP12_SQL}
