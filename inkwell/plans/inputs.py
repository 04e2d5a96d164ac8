"""Derived inputs that both Spark and the checking SQL can build by one and the same expression.

The driver tables have few quotes, controls or blank lines, so texts get some by a rule on doc_id.
"""

NL = "\n"
#: Texts with reader controls, navigation, quotes, zero-width characters, blank lines and thoughts; valid in both dialects.
DECORATED = f"""CASE doc_id % 6
 WHEN 0 THEN text
 WHEN 1 THEN concat('Raws{NL}Translate{NL}  Reader   Settings {NL}A+{NL}', text, '{NL} Next Chapter {NL}Chapter 12{NL}← Back to novel')
 WHEN 2 THEN concat('"', replace(text, '{NL}', '"{NL}{NL}  "'), '"')
 WHEN 3 THEN concat('​Alice: ', replace(text, '{NL}', '{NL}{NL} {NL}Bob:  ⁠ '))
 WHEN 4 THEN concat('Forum{NL}Theme{NL}*', replace(text, '{NL}', '*{NL}('), ')')
 ELSE concat('She said (he heard): they [left] him.{NL}', replace(text, '. ', '! He saw Alice. Her hat, his! '), '{NL}subscribe now{NL}Dark{NL}reader mode on')
END"""

#: Lines that alternate between speech, naming, thought and prose, by row.
LINE_KIND = """CASE (doc_id + pos) % 6 WHEN 0 THEN concat('"', line, '"') WHEN 1 THEN concat('Alice: ', line) WHEN 2 THEN concat('*', line, '*') WHEN 3 THEN concat('“', line, '”') WHEN 4 THEN concat('word — ', line) ELSE line END"""

#: A speaker's name with odd spellings, from a customer number.
SPEAKER = """CASE c_custkey % 7 WHEN 0 THEN concat(' ', lower(c_name), '.') WHEN 1 THEN upper(c_name) WHEN 2 THEN concat(c_name, ' ,!') WHEN 3 THEN 'Narrator' WHEN 4 THEN ' UNKNOWN ;' WHEN 5 THEN '' ELSE c_name END"""
