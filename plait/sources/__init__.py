"""plait.sources"""
