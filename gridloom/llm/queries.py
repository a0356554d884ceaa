"""Named queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from gridloom.llm.alignment import op13_alignment
from gridloom.llm.ann import op4_ann
from gridloom.llm.bpe import op9_bpe
from gridloom.llm.collocations import op12_collocations, op12_sql
from gridloom.llm.embeddup import op3_embeddup, op3_sql
from gridloom.llm.langid import op6_langid
from gridloom.llm.licenses import op7_licenses, op7_sql
from gridloom.llm.lines import op11_lines, op11_sql
from gridloom.llm.minhash import op2_minhash, op2_sql
from gridloom.llm.packing import op8_packing
from gridloom.llm.substrings import op10_sql, op10_substrings
from gridloom.llm.toxicity import op1_toxicity
from gridloom.llm.urls import op5_urls

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash": op2_minhash,
    "op3_embeddup": op3_embeddup,
    "op4_ann": op4_ann,
    "op5_urls": op5_urls,
    "op6_langid": op6_langid,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_bpe": op9_bpe,
    "op10_substrings": op10_substrings,
    "op11_lines": op11_lines,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": op2_sql(),
    "op3_embeddup": op3_sql(),
    "op7_licenses": op7_sql(),
    "op10_substrings": op10_sql(),
    "op11_lines": op11_sql(),
    "op12_collocations": op12_sql(),
}
