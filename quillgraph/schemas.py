"""Schemas of all record kinds, as DDL; nothing is inferred from data."""

RELATIONS = "relations struct<raw:string,remedies:array<string>>"

RUBRIC_RECORD = "chapter string, rubric string, remedies array<struct<name:string,grade:int>>, grade3 array<string>, page string, source string, layer string, url string"
RUBRICS = "id bigint, chapter string, rubric string, page string, url string"
RUBRIC_REMEDIES = "rubric_id bigint, remedy_raw string, remedy_canonical string, grade int"
FIELD_MONOGRAPH = f"remedy string, source string, url string, intro string, keynotes array<string>, fields map<string,string>, modalities map<string,string>, {RELATIONS}, raw_text string"
DICTIONARY_RECORD = f"remedy string, source string, url string, fields map<string,string>, clinical array<string>, keynotes array<string>, modalities map<string,string>, {RELATIONS}, raw_text string"
PROSE_RECORD = f"remedy string, source string, url string, keynotes array<string>, {RELATIONS}, raw_text string, remedy_mentions array<string>"
KEYNOTE_RECORD = f"remedy string, name_full string, source string, layer string, url string, keynotes array<string>, keynotes_text string, modalities map<string,string>, {RELATIONS}, raw_text string"
SYMPTOM = "struct<text:string,important:boolean,clinical:string>"
SECTIONED_RECORD = f"remedy string, abbrev string, source string, layer string, url string, sections array<struct<no:int,name:string,symptoms:array<{SYMPTOM}>>>, n_symptoms int, {RELATIONS}, raw_text string"
APHORISM = "aphorism_no int, edition string, text string, footnotes array<struct<marker:string,text:string>>, source string, layer string, url string"
LECTURE = "lecture_no int, title string, reference string, aphorisms array<int>, mentions array<int>, text string, n_words int, source string, layer string, url string"
ALIAS_TABLE = "canonical string, aliases array<string>, sources array<string>"
CHUNK = "id string, text string, source string, layer string, locator string, url string, remedy string, sparse boolean, parent_locator string, section_no int, has_important boolean, clinical array<string>"
VECTOR = "id string, text string, book string, subject string, locator string, layer string, url string, sparse boolean, remedy string, embedding array<float>"
HIT = "chunk_id string, text string, book string, subject string, locator string, similarity double, sparse boolean"
QUESTION = "question string, options array<string>, correct_index int, explanation string, supporting_quote string, mnemonic string, exam_tip string, difficulty string"
VERDICT = "supported boolean, unsupported_claims array<string>, quote_found_in_source boolean, reason string"
CALL_METRICS = "task string, model string, path string, latency_ms int, input_tokens int, output_tokens int, ts double"
GOLD_CASE = "topic string, subject string, expect string, expect_locator string"
GOLD_FORWARD = "id string, rubric_id bigint, chapter string, rubric string, correct_remedy string, grade3_all array<string>, distractor_pool array<string>, page string, expect string, qtype string, path string"
GOLD_REVERSE = "id string, remedy string, qtype string, expect_rubrics array<string>, path string"
HTML_PAGE = "path string, html string"
DIFFICULTIES = ("easy", "moderate", "hard")
