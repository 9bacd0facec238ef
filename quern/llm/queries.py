"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quern.llm import oracle
from quern.llm.chat import op5_chat
from quern.llm.decontaminate import op3_decontamination
from quern.llm.filters import op11_filter_audit
from quern.llm.language import op10_language
from quern.llm.licenses import op13_licenses
from quern.llm.lm import op7_lm_scores
from quern.llm.minhash import op4_fingerprints
from quern.llm.mixing import op8_mixing
from quern.llm.periodic import op12_periodic_runs
from quern.llm.repeats import op6_repeats
from quern.llm.secrets import op9_secrets
from quern.llm.simhash import op2_simhash
from quern.llm.token_file import op1_token_ids

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprints": op4_fingerprints,
    "op5_chat": op5_chat,
    "op6_repeats": op6_repeats,
    "op7_lm_scores": op7_lm_scores,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat": oracle.CHAT,
    "op8_mixing": oracle.MIXING,
    "op11_filter_audit": oracle.FILTERS,
    "op13_licenses": oracle.LICENSES,
}
