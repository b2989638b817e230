"""tracelode.plans"""
