"""quire: a PySpark engine that turns long-form documents into relations.

HTML and text go in; tables of contents, sections, paragraphs, sentences, page
chunks, a catalogue, work manifests and timelines come out as DataFrames.
"""
