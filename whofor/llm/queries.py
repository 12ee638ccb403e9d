"""The registered queries of this package, and their SQL where SQL can express them."""

from whofor.llm.bpe import op7_byte_bpe
from whofor.llm.chats import op12_chats
from whofor.llm.decontaminate import op8_decontaminate
from whofor.llm.itq import op1_itq
from whofor.llm.language import op9_language
from whofor.llm.lines import op4_lines
from whofor.llm.maxent import op5_maxent
from whofor.llm.minhash import op3_minhash
from whofor.llm.pii import op10_personal_data
from whofor.llm.resample import op13_resample
from whofor.llm.secrets import op6_secrets
from whofor.llm.spelling import op11_spelling
from whofor.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_itq": op1_itq,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_lines": op4_lines,
    "op5_maxent": op5_maxent,
    "op6_secrets": op6_secrets,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_personal_data": op10_personal_data,
    "op11_spelling": op11_spelling,
    "op12_chats": op12_chats,
    "op13_resample": op13_resample,
}
ORACLES: dict[str, str] = {}
