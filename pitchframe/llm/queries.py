"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from .chat import CHAT_SQL, op9_chat
from .codes import CODES_SQL, op13_vector_codes
from .complement import op11_complement_packing
from .iblt import op5_fingerprints
from .language import op10_language
from .neighbours import op2_neighbours
from .packing import op4_packing
from .pieces import op1_sentencepiece
from .pii import op6_pii
from .quality import op7_quality
from .resampling import RESAMPLING_SQL, op12_resampling
from .simhash import op8_simhash
from .token_files import op3_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_neighbours, op3_token_files, op4_packing, op5_fingerprints, op6_pii, op7_quality, op8_simhash, op9_chat, op10_language,
        op11_complement_packing, op12_resampling, op13_vector_codes,
    )
}

ORACLES = {"op9_chat": CHAT_SQL, "op12_resampling": RESAMPLING_SQL, "op13_vector_codes": CODES_SQL}
