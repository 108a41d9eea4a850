"""Schemas shared by sources and plans (DDL strings)."""

from __future__ import annotations

CODE = "struct<code:string,system:string>"

INGREDIENT = (
    "struct<class_code:string,legacy_role:string,direct:boolean,name:string,has_substance:boolean,"
    f"codes:array<{CODE}>,num_value:string,num_unit:string,den_value:string,den_unit:string>"
)

SUBJECT = (
    "struct<container:int,kind:string,nth:int,name:string,form:string,route:string,container_route:string,"
    f"ndc_codes:array<string>,ingredients:array<{INGREDIENT}>>"
)

SECTION = (
    "struct<code:string,code_name:string,title:string,has_text:boolean,raw_text:string,chunks:array<string>,"
    "tables:array<array<array<struct<tag:string,value:string>>>>,lines:array<string>>"
)

# what the XML reader extracts from one label document
DOCUMENT = (
    "struct<doc_code:string,doc_type:string,title:string,author_org:string,any_org:string,route:string,form:string,"
    f"names:array<string>,forms:array<string>,codes:array<{CODE}>,text_ndcs:array<string>,"
    f"subjects:array<{SUBJECT}>,ingredients:array<{INGREDIENT}>,sections:array<{SECTION}>>"
)

# one XML member of a nested archive, or the failure to read it
MEMBER = (
    "path string, source_file string, member_seq int, xml_seq int, member string, setid string, xml string, "
    "error_type string, error_message string"
)

ACTIVE = "struct<name:string,strength:string,unii:string>"
INACTIVE = "struct<raw_name:string,normalized_name:string,unii:string>"

# one product subject of a label
RECORD = (
    "setid string, source_file string, subject_seq int, product_name string, labeler string, dosage_form string, "
    f"route string, product_type string, ndcs array<string>, actives array<{ACTIVE}>, inactives array<{INACTIVE}>"
)
WRITE_ORDER = ["source_file", "member_seq", "xml_seq", "subject_seq"]

PROCESSING_LOG = "source_file string, status string, message string, processed_at timestamp"
