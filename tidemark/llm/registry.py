"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import chat, phrases, search, secrets, vafile
from .bpe import op1_bpe_chunks
from .chat import op6_chats
from .counts import op11_token_cache
from .html import op2_html_density
from .mixing import op7_mixing
from .phrases import op12_collocations
from .quality import op3_quality
from .search import op13_bag_search
from .secrets import op9_secrets
from .simhash import op10_simhash
from .sstable import op5_sstable
from .vafile import op8_vafile
from .winnow import op4_winnowing

QUERIES = {
    "op1_bpe_chunks": op1_bpe_chunks,
    "op2_html_density": op2_html_density,
    "op3_quality": op3_quality,
    "op4_winnowing": op4_winnowing,
    "op5_sstable": op5_sstable,
    "op6_chats": op6_chats,
    "op7_mixing": op7_mixing,
    "op8_vafile": op8_vafile,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_token_cache": op11_token_cache,
    "op12_collocations": op12_collocations,
    "op13_bag_search": op13_bag_search,
}

SQL = {"op6_chats": chat.SQL, "op8_vafile": vafile.SQL, "op9_secrets": secrets.SQL, "op12_collocations": phrases.SQL, "op13_bag_search": search.SQL}
