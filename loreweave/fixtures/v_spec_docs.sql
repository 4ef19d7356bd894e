select concat('SPEC-', cast(doc_id as string)) as spec_id, text as markdown from documents
