"""The queries of this subpackage, by name, and DuckDB SQL where SQL can express one."""

from palimpsest.llm.decontamination import OP2_SQL, op2_decontaminate
from palimpsest.llm.factor_machine import op7_quality_score
from palimpsest.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from palimpsest.llm.filter_audit import OP12_SQL, op12_filter_audit
from palimpsest.llm.licenses import OP4_SQL, op4_licenses
from palimpsest.llm.nearest import op11_nearest
from palimpsest.llm.packing import op5_pack
from palimpsest.llm.quality_rules import op9_quality_rules
from palimpsest.llm.sharding import op3_shards
from palimpsest.llm.simhash import op6_simhash
from palimpsest.llm.suffix_dedup import op10_suffix_dedup
from palimpsest.llm.token_counts import op1_token_counts
from palimpsest.llm.token_files import op8_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontaminate, op3_shards, op4_licenses, op5_pack, op6_simhash, op7_quality_score, op8_token_files, op9_quality_rules, op10_suffix_dedup, op11_nearest,
        op12_filter_audit, op13_fill_in_middle,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op4_licenses": OP4_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
