"""tracelode.operators"""
