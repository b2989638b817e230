"""tracelode.sources"""
