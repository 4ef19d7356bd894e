select doc_id as rank, concat('SPEC-', cast(doc_id as string)) as spec_id, regexp_extract(text, '([a-z]{9,})', 1) as keyword from documents where length(regexp_extract(text, '([a-z]{9,})', 1)) > 0
