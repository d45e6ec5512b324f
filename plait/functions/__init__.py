"""plait.functions"""
