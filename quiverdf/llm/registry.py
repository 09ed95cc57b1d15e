"""The queries that this package registers, and the SQL of those that SQL can express."""

from quiverdf.llm.chat import OP4_SQL, op4_format_chats
from quiverdf.llm.decontamination import OP5_SQL, op5_decontamination
from quiverdf.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from quiverdf.llm.jaccard import op9_jaccard_join
from quiverdf.llm.licences import OP10_SQL, op10_licence_scan
from quiverdf.llm.mixing import OP7_SQL, op7_mix_sources
from quiverdf.llm.passages import op6_repeated_passages
from quiverdf.llm.secrets import op3_secret_scan
from quiverdf.llm.sharding import op2_balanced_shards
from quiverdf.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_balanced_shards": op2_balanced_shards,
    "op3_secret_scan": op3_secret_scan,
    "op4_format_chats": op4_format_chats,
    "op5_decontamination": op5_decontamination,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_mix_sources": op7_mix_sources,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_licence_scan": op10_licence_scan,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op4_format_chats": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op10_licence_scan": OP10_SQL,
}
