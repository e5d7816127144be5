"""Schemas of the entities."""

from __future__ import annotations

BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
PIXEL_BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
BLOCK = "struct<text:string,speaker_id:string,is_speech:boolean,sfx:string,voice:string>"
BUBBLE = f"volume string, page int, panel int, pos int, text string, language string, bbox {BOX}"
PANEL = f"volume string, page_number int, panel_index int, image_path string, bbox {BOX}, blocks array<{BLOCK}>"
PLAN_ITEM = "volume string, pos int, sub int, kind string, speaker_id string, text string, sfx_tag string, seed string, block_index int"
SEGMENT_AUDIO = "volume string, block_index int, file_path string, speaker_id string, duration_ms int"
TRANSCRIPT = "file string, start double, end double, text string, words array<struct<start:double,end:double,word:string,probability:double>>"
ARC = "start_s double, title string"
DETECTION = f"page string, idx int, label string, confidence double, box {PIXEL_BOX}"
DETECTIONS_JSON = "map<string,array<struct<label:string,confidence:double,box:array<int>>>>"
EXEMPLAR = "ord int, name string, v array<float>"
LABEL = "mode string, key string, text string, label string, predicted string, verdict string, true_count int, box array<int>, confidence double"
SFX_DICTIONARY = "map<string,array<struct<file:string,gain:double,auto_tags:array<string>>>>"
RUN_CONFIG = "stage string, component string, fingerprint string"
