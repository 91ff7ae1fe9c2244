from helpline.functions.columns import (  # noqa: F401
    opt, page_of, ordered_join, nullif_empty, content_hash, role_label, word_count, fold_accents,
)
