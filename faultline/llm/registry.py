"""The queries of this subpackage by name, and their SQL."""

from . import op1_lang_id, op10_html_extract, op11_search, op12_divergence, op13_secrets, op2_url_filter, op3_packing, op4_mixing, op5_quality, op6_exact_dedup, op7_warc, op8_sharding, op9_simhash

_MODULES = (op1_lang_id, op2_url_filter, op3_packing, op4_mixing, op5_quality, op6_exact_dedup, op7_warc, op8_sharding, op9_simhash, op10_html_extract, op11_search, op12_divergence, op13_secrets)
QUERIES = {m.NAME: m.query for m in _MODULES}
SQL = {m.NAME: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
