"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from canvass.llm.ann import op7_nearest
from canvass.llm.bpe import op10_bpe
from canvass.llm.htmltext import op5_html_extraction
from canvass.llm.langid import op2_language_id
from canvass.llm.licences import OP4_SQL, op4_license_scans
from canvass.llm.mixing import OP9_SQL, op9_mixing
from canvass.llm.simhash import op8_simhash
from canvass.llm.tokencount import op3_token_counts
from canvass.llm.urlfilter import op1_url_filters
from canvass.llm.winnow import op6_fingerprints

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_language_id, op3_token_counts, op4_license_scans, op5_html_extraction,
        op6_fingerprints, op7_nearest, op8_simhash, op9_mixing, op10_bpe,
    )
}
ORACLE_SQL = {"op4_license_scans": OP4_SQL, "op9_mixing": OP9_SQL}
