"""tracelode.streaming"""
