"""quillmill.sinks"""
